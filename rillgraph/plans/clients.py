"""Models that are not part of this package, by name: ``module:function``, importable on the driver and on executors.

* subjects: called with ``(model, score_mode)``, gives a :class:`rillgraph.operators.subjects.SubjectClassifier`;
* graphs: called with ``(model, temperature)``, gives a function from a post's text to an answer;
* embeddings: called with ``(model, max_length)``, gives a function from a list of phrases to their raw vectors.

The functions for graphs and embeddings are called in the tasks that use them, once each, so that a model is loaded where
it runs and is not sent there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from importlib import import_module

from rillgraph.config import Options
from rillgraph.operators.subjects import SubjectClassifier


def named(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    if not module or not function:
        raise ValueError(f"no client: {name!r} is not module:function")
    return getattr(import_module(module), function)


@lru_cache(4)
def _loaded(name: str, *arguments: object) -> Callable:
    return named(name)(*arguments)


def classifier(options: Options) -> SubjectClassifier:
    return named(options.subject_client)(options.subject_model, options.subject_score_mode)


def asker(options: Options) -> Callable[[str], str]:
    name, model, temperature = options.kg_client, options.kg_model, options.kg_temperature
    named(name)
    return lambda text: _loaded(name, model, temperature)(text)


def encoder(options: Options) -> Callable[[list[str]], object]:
    name, model, length = options.embed_client, options.embed_model, options.embed_max_length
    named(name)
    return lambda phrases: _loaded(name, model, length)(phrases)
