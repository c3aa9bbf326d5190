"""SQL for the queries that SQL can express. The rest is tested against brute force, round trips or held-out data."""

from __future__ import annotations

import unicodedata

from rillgraph.llm.canonical import _TO_LATIN, PERSIAN, PERSIAN_MARKED


def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters with a one-character compatibility form, those forms, and the forms of more characters."""
    one, many = {}, {}
    for low, high in ((0xA0, 0x250), (0x2000, 0x2100), (0x3000, 0x3001), (0xFB00, 0xFE00), (0xFE70, 0x10000)):
        for c in map(chr, range(low, high)):
            form = unicodedata.normalize("NFKC", c)
            if form != c and unicodedata.category(c) not in ("Cn", "Cs", "Cf"):
                (one if len(form) == 1 else many)[c] = form
    digits = {c: str(unicodedata.decimal(c)) for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd"}
    table = one | digits | PERSIAN
    table |= {c: PERSIAN.get(f, f) for c, f in one.items()}
    quoted = lambda x: "".join(x).replace("'", "''")
    known = {c: f for c, f in many.items() if c in "ﬀﬁﬂﬃﬄﬅﬆ" or 0xFEF5 <= ord(c) <= 0xFEFC}
    return quoted(table), quoted(table.values()), known


def consistent_sql(c: str) -> str:
    """An expression for the consistent form of the string ``c``."""
    source, target, ligatures = _tables()
    x = f"regexp_replace({c}, '[\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{180e}}\\x{{200b}}\\x{{200d}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}]', '', 'g')"
    for a, b in ligatures.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"translate({x}, '{source}', '{target}')"
    for a, b in PERSIAN_MARKED.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"trim(regexp_replace(nfc_normalize({x}), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{200c}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
    latin = f"translate(w, '{''.join(map(chr, _TO_LATIN))}', '{''.join(_TO_LATIN.values())}')"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: case when regexp_matches(w, '[A-Za-z\\x{{c0}}-\\x{{24f}}]') then {latin} else w end), ' ')"


TOKENS = f"""once as (select pid, any_value(tokens) tokens, any_value(types) types, any_value(user_id) user_id, any_value(line_starts) line_starts from posts group by pid),
forms as materialized (select t, {consistent_sql("t")} f from (select distinct unnest(tokens) t from posts)),
placed as materialized (select pid, i, f from (select pid, unnest(range(len(tokens))) i, unnest(tokens) t from once) join forms using (t))"""
LINES = (
    TOKENS
    + """,
starts as (select pid, user_id, unnest(range(len(line_starts))) line_no, unnest(line_starts) a, unnest(list_concat(line_starts[2:], [len(tokens)])) b, tokens from once where user_id is not null and len(tokens) > 0),
lines as (select s.pid, s.user_id, s.line_no, string_agg(case when regexp_full_match(f, '[0-9]+') then '0' else f end, chr(1) order by i) body from starts s join placed p on p.pid = s.pid and i >= a and i < b group by all),
often as (select user_id, body from lines group by all having count(distinct pid) >= 8),
repeated as (select pid, line_no from lines join often using (user_id, body))"""
)
COUNTS = (
    TOKENS
    + """,
every as (select 'tokens' field_name, f term, pid from placed union all select 'types', unnest(types), pid from once),
counts as (select field_name, term, count(*) occurrences, count(distinct pid) posts from every where term is not null group by all),
freq as (select *, case when posts < 3 then 'rare' when posts > 0.05 * (select count(*) from once where len(tokens) > 0) then 'common' end verdict from counts)"""
)
SETS = (
    TOKENS
    + """,
sets as materialized (select distinct pid, f from placed), sizes as (select pid, count(*) n, string_agg(f, chr(1) order by f) body from sets group by pid),
ranked as materialized (select pid, f, n, row_number() over (partition by pid order by c, f) k from sets join sizes using (pid) join (select f, count(*) c from sets group by f) using (f)),
near as (select distinct a.pid x, b.pid y, a.n an, b.n bn from ranked a join ranked b on a.f = b.f and a.pid < b.pid
  where a.k <= a.n - ceil(0.7 * a.n - 1e-9) + 1 and b.k <= b.n - ceil(0.7 * b.n - 1e-9) + 1 and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9),
pairs as materialized (select x, y from near join sets a on a.pid = x join sets b on b.pid = y and b.f = a.f group by x, y, an, bn having count(*) * 10 >= 7 * (an + bn - count(*)))"""
)
VECTORS = """vs as (select vec_id, any_value(vector) v from (select vec_id, vector from subject_events union all select vec_id, vector from final_events) where vector is not null group by 1),
us as materialized (select vec_id, list_transform(v, lambda x: cast(x as double)) v from vs where list_max(list_transform(v, lambda x: abs(x))) > 0),
sims as (select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.v, b.v), 12) s from us a join us b on a.vec_id <> b.vec_id),
top as (select *, row_number() over (partition by a order by s desc, b) k from sims)"""

_BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{200c}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{ad}\x{200b}\x{200d}-\x{200f}\x{2060}\x{feff}"
QUALITY = rf"""known as (select distinct lower({consistent_sql("word")}) w from common_words where word is not null),
texts as (select doc_id, coalesce(text, '') t from documents),
parts as (select doc_id, t, length(regexp_replace(t, '[{_BLANK}]', '', 'g')) shown, regexp_extract_all(t, '\p{{L}}+') ws, length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) digits,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[{_BLANK}]+$', '')), lambda x: x <> '' and regexp_matches(x, '[^{_BLANK}]')) ls from texts),
sums as (select *, len(ws) n, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) letters, len(ls) k, len(list_filter(ls, lambda x: right(x, 1) in ('.', '!', '?', '؟', '…', ':', '"', '»', ')'))) closed from parts),
hits as (select doc_id, count(*) common from (select doc_id, lower(translate(unnest(ws), 'يىكڪہەھ', 'ییککههه')) w from parts) where w in (select w from known) group by 1)"""

ORACLE: dict[str, str] = {
    "p1_found": f"with {LINES} select distinct pid, line_no::integer line_no from repeated",
    "p1_clean_posts": f"""with {LINES}, cut as (select pid, list(line_no) ls from repeated group by 1), ends as (select pid, tokens, coalesce(ls, []) ls, case when len(line_starts) > 0 then line_starts else [0] end ss from posts left join cut using (pid))
select pid, case when len(ls) = 0 then tokens else list_concat(tokens[1:ss[1]], flatten(list_transform(list_filter(range(len(ss)), lambda i: not list_contains(ls, i)), lambda i: tokens[ss[i + 1] + 1:coalesce(ss[i + 2], len(tokens))]))) end tokens, len(ls)::integer removed_lines from ends""",
    "p2_found": f"with {COUNTS} select field_name, term, verdict from freq where verdict is not null",
    "p2_frequencies": f"with {COUNTS} select * from freq",
    "p3_found": f"""with {TOKENS}, bad as (
  select 'token' place, pid rec_id, unnest(range(len(tokens))) pos, -1 slot, unnest(tokens) v from once union all
  select 'triple', seq, pos, unnest(range(len(m))), unnest(m) from (select seq, unnest(range(len(triples))) pos, unnest(triples) m from kg_store))
select place, rec_id, pos::integer pos, slot::integer slot from (select *, {consistent_sql("v")} c from bad) where v <> c""",
    "p4_found": f"""with {SETS}, nth as (select pid, body, row_number() over (partition by body order by pid) k from sizes)
select x pid_a, y pid_b from pairs join nth a on a.pid = x join nth b on b.pid = y where a.k <= 16 and (b.k <= 16 or a.body = b.body)""",
    "p4_classes": f"""with {SETS}, reps as (select body, min(pid) rep, count(*) n_copies from sizes group by 1), of as (select pid, rep, n_copies from sizes join reps using (body)),
links as (select a.rep r, count(distinct b.rep) n from (select x, y from pairs union all select y, x from pairs) join of a on a.pid = x join of b on b.pid = y where a.rep <> b.rep group by 1)
select pid, rep class_id, n_copies, coalesce(n, 0) n_links from of left join links on r = rep""",
    "p6_found": f"with {VECTORS} select distinct least(a, b) vec_a, greatest(a, b) vec_b from top where k <= 5 and s >= 0.9",
    "p6_similar": f"with {VECTORS} select a vec_id, k::integer as rank, b other, round(s, 6) cosine from top where k <= 5 and a % 100 = 0",
    "p7_checked": "select spec_id, (select count(*) from documents) documents, 0::bigint overfull, 0::bigint split, 0::bigint broken, false wasteful from pack_specs where capacity >= 1 group by 1",
    "p8_mix_characters": """with t0 as (select source, max(target_share) share, max(max_repeats) repeats from mix_targets where source is not null and target_share > 0 and max_repeats >= 1 group by 1),
t as (select source, share / sum(share) over () share, repeats from t0), d as (select doc_id, source, length(text) n from documents join t using (source) where length(text) > 0),
k as (select *, concat('0x', substr(md5('0-' || doc_id), 1, 13))::bigint as key from d), s as (select source, sum(n) tokens from d group by 1),
upto as (select *, sum(n) over (partition by source order by key, doc_id rows unbounded preceding) upto from k),
r as (select *, unnest(range(repeats)) repeat_no from upto join s using (source) join t using (source)),
f as (select source, doc_id, repeat_no, n, round((repeat_no * tokens + upto) / share, 6) as finish from r),
g as (select *, sum(n) over (order by finish, source, doc_id, repeat_no rows unbounded preceding) total from f)
select source, doc_id, repeat_no::integer repeat_no, n::bigint n_tokens, round(finish, 2) finish_time, total::bigint total from g where total <= (select min(repeats * tokens / share) from s join t using (source))""",
    "p9_statistics": f"""with {QUALITY} select doc_id, case when shown = 0 then 0.0 else length(t)::double end n_chars, n::double n_words, k::double n_lines, round(letters / greatest(n, 1), 6) mean_word_length,
round(case when shown = 0 then 0.0 else greatest(0.0, 1 - digits / shown - letters / shown) end, 6) symbol_ratio, round(digits / greatest(shown, 1), 6) digit_ratio, round(letters / greatest(shown, 1), 6) letter_ratio,
round(closed / greatest(k, 1), 6) punctuated_lines, round(coalesce(common, 0) / greatest(n, 1), 6) common_words from sums left join hits using (doc_id)""",
}
