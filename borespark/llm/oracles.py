"""SQL for DuckDB that gives the registered queries' rows by plain means: all pairs, all windows, all matches."""

from __future__ import annotations

#: The rules once more, written for this engine and apart from the code that they check: kind, expression, group to measure, least length, base rule.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", "AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", "[0-9a-f]+", 0, 24, True),
    ("bearer", r"[bB]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20, False),
    ("code_host", "gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 15, False),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, False),
    ("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 1, False),
    ("url_login", r"[a-z]+://[^\t\n\x0B\f\r\x20:/@]+:([^\t\n\x0B\f\r\x20/@]+)@", 1, 3, False),
)

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce({{}}, ''), '{_SPACES}'), lambda x: x <> '')"


def _reach(pairs: str, nodes: str) -> str:
    """root (id, component): the smallest id reachable over pairs (a, b), both ways."""
    return f"""reach as (select id, id other from {nodes} union select reach.id, p.b from reach join {pairs} p on p.a = reach.other),
root as (select id, min(other) component from reach group by 1)"""


def _matches(k: int) -> str:
    """Spans of one rule: the text between matches gives their places."""
    _, pattern, group, least, _ = _SECRETS[k]
    pattern = pattern.replace("'", "''")
    return f"""select id, {k} kind_no, start, start + n stop from (
select id, unnest(lens) n, unnest(tests) t, unnest(list_transform(range(1, len(lens) + 1), lambda i: list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0)))::bigint start from (
select id, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) gaps, list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) lens, list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x)) tests from d)) where t >= {least}"""


_KINDS = "['" + "', '".join(r[0] for r in _SECRETS) + "'][kind_no + 1]"
_BASE = ", ".join(str(i) for i, r in enumerate(_SECRETS) if r[4])
OP2 = f"""with d as (select row_number() over () id, doc_id, coalesce(text, '') text from documents),
s as ({' union all '.join(_matches(k) for k in range(len(_SECRETS)))}),
o as (select id, {', '.join(f"count(*) filter (kind_no = {i}) n_{r[0]}" for i, r in enumerate(_SECRETS) if r[4])}, string_agg({_KINDS} || ':' || start || ':' || stop, ',' order by start, kind_no) filter (kind_no in ({_BASE})) base, string_agg({_KINDS} || ':' || start || ':' || stop, ',' order by start, kind_no) spans, count(*) n from s group by 1)
select doc_id, {', '.join(f'coalesce(n_{r[0]}, 0)::bigint n_{r[0]}' for r in _SECRETS if r[4])}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n, 0)::bigint n_spans from d left join o using (id)"""

_USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
OP3 = f"""with recursive v as (select vec_id id, label, embedding::double[] x from embeddings where {_USABLE} and label is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select s.id a, t.id b from v s join v t using (label) where s.id <> t.id and len(s.x) = len(t.x) and list_dot_product(s.x, t.x) / sqrt(list_dot_product(s.x, s.x) * list_dot_product(t.x, t.x)) >= 0.93),
{_reach('p', '(select vec_id id from embeddings)')},
n as (select a id, count(*) links from p group by 1)
select vec_id, coalesce(links, 0)::bigint n_links, component component_id, vec_id = component kept from embeddings join root on root.id = vec_id left join n on n.id = vec_id"""

OP6 = f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) x from embeddings where {_USABLE}),
s as (select q.vec_id query_id, v.vec_id, list_dot_product(q.x, v.x)::bigint score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

OP11 = f"""with v as (select distinct vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * x::double)) x from embeddings where {_USABLE} and vec_id is not null and label is not null and len(embedding) > 0),
s as (select a.id a, a.lab lab, v.lab other, v.id id, list_dot_product(a.x, v.x)::bigint score from v a join v on v.id <> a.id and len(v.x) = len(a.x) where a.id % 100 = 0),
p as (select a, id positive_id, score positive_score, row_number() over (partition by a order by score desc, id) k from s where lab = other),
n as (select p.a anchor_id, positive_id, row_number() over (partition by p.a, positive_id order by score desc, id)::int rank, id negative_id, positive_score, score negative_score from p join s on s.a = p.a and s.lab <> s.other and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score where k <= 5)
select * from n where rank <= 10"""

OP7 = f"""with recursive w as (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws from documents),
s as (select doc_id, list_distinct(case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) x from w),
n as (select doc_id, len(x)::bigint n from s),
g as (select doc_id, unnest(x) gram from s),
f as (select gram, count(*) k from g group by 1),
o as (select doc_id, gram, row_number() over (partition by doc_id order by k, gram) place from g join f using (gram)),
c as (select distinct s.doc_id a, t.doc_id b from (o join n using (doc_id)) s join (o join n using (doc_id)) t on s.gram = t.gram and s.doc_id < t.doc_id where s.place <= s.n - ceil(0.8 * s.n) + 1 and t.place <= t.n - ceil(0.8 * t.n) + 1 and 100 * least(s.n, t.n) >= 80 * greatest(s.n, t.n)),
i as (select a, b, len(list_intersect(s.x, t.x)) same, len(s.x) + len(t.x) both_ from c join s on s.doc_id = a join s t on t.doc_id = b),
l as (select a, b from i where 100 * same >= 80 * (both_ - same)),
p as (select a, b from l union all select b, a from l),
{_reach('p', '(select doc_id id from documents)')}
select doc_id, n n_shingles, component component_id, doc_id = component kept from n join root on root.id = doc_id"""

OP9 = f"""with w as (select doc_id, {_WORDS.format('text')} ws from documents),
win as (select doc_id, i, list_aggregate(ws[i:i + 19], 'string_agg', ' ') s from (select doc_id, ws, unnest(range(1, len(ws) - 18)) i from w)),
r as (select doc_id, i, row_number() over (partition by s order by doc_id, i) k, count(*) over (partition by s) n from win),
gone as (select doc_id, list_distinct(flatten(list(range(i, i + 20)))) places from r where k > 1 group by 1),
met as (select distinct doc_id, unnest(range(i, i + 20)) word from r where n > 1),
runs as (select doc_id, count(*) size from (select doc_id, word, word - row_number() over (partition by doc_id order by word) island from met) group by doc_id, island),
passages as (select doc_id, count(*) filter (size >= 51) n from runs group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(len(places), 0)::bigint n_removed, sha256(coalesce(list_aggregate(case when places is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(places, i)), lambda i: ws[i]) end, 'string_agg', ' '), '')) kept_sha256, coalesce(n, 0)::bigint n_passages from w left join gone using (doc_id) left join passages using (doc_id)"""

_BOOK = f"""with w as (select row_number() over () id, doc_id, coalesce(text, '') text, {_WORDS.format('text')} ws from documents),
win as (select id, i, ws[i:i + 2] s from (select id, ws, unnest(range(1, len(ws) - 1)) i from w)),
again as (select id, i from (select id, i, count(*) over (partition by id, s) n from win) where n > 1),
r as (select id, count(distinct p) n from (select id, unnest([i, i + 1, i + 2]) p from again) group by 1),
li as (select id, count(*) n, count(distinct line) d from (select id, unnest(string_split(text, chr(10))) line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
m as (select doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, coalesce(li.n - li.d, 0)::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, coalesce(li.n, 0) n_lines, len(regexp_extract_all(text, '[0-9]')) n_digits from w left join r using (id) left join li using (id)),
f as (select *, n_words < 50 f0, 100 * n_repeat_words > 50 * n_words f1, 100 * n_symbols > 10 * n_words f2, 100 * n_dup_lines > 50 * n_lines f3, word_chars > 12 * n_words or word_chars < 2 * n_words f4, 100 * n_digits > 40 * word_chars f5 from m)
"""
OP12 = _BOOK + """select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 or f1 base_failed, not (f0 or f1 or f2 or f3 or f4 or f5) kept, (f0::int + 2 * f1::int + 4 * f2::int + 8 * f3::int + 16 * f4::int + 32 * f5::int)::bigint failed, 3 policy from f"""


def _ablation(version: int, rules: dict[int, str]) -> str:
    out = lambda keys: " or ".join(f"f{k}" for k in keys) or "false"
    return " union all ".join(
        f"select {version} policy, '{name}' rule, count(*) n_docs, count(*) filter (not ({out(rules)})) n_kept, count(*) filter (f{k}) n_failed, count(*) filter (f{k} and not ({out([j for j in rules if j != k])})) n_only, count(*) filter (not ({out([j for j in rules if j != k])})) n_kept_without from f having count(*) > 0"
        for k, name in rules.items()
    )


_NAMES = dict(enumerate(("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "digits")))
OP12_ABLATIONS = _BOOK + " union all ".join(_ablation(v, {k: _NAMES[k] for k in range(n)}) for v, n in ((1, 2), (2, 4), (3, 6)))

ORACLES = {"op11_hard_negatives": OP11, "op12_quality_rules": OP12, "quality_rule_ablations": OP12_ABLATIONS, "op2_secrets": OP2, "op3_embedding_near_dup": OP3, "op6_topk": OP6, "op7_minhash": OP7, "op9_substring": OP9}
