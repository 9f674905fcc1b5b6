"""Registered queries of the training-data operators: name -> callable
``(spark, sf_dir)``, and the DuckDB twin where SQL can express the result.

Each query applies its operator to its whole table with production parameters
and derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_tree import prefix_tree, read_back
from .common import table
from .decontaminate import contamination
from .importance import resample
from .line_quality import held_out, score, train
from .near_dedup import near_duplicates
from .packing import pack
from .passage_dedup import remove_passages
from .quality_rules import cascade
from .secrets import BASE, KINDS, scan
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .trie_bpe import decode, encode
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return register


CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l as (select conv_id, string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant') as loss from c group by conv_id),
t as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
        sum(17 + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>')) - 1 + length(replace(replace(text, '\', '\\'), '<', '\<')))::bigint as formatted_chars
      from c group by conv_id)
select t.conv_id, n_turns, sha256(said) as turns_sha256, length(coalesce(loss, ''))::bigint as loss_chars, sha256(coalesce(loss, '')) as loss_sha256, formatted_chars
from t left join l on t.conv_id is not distinct from l.conv_id"""


@query("op1_chat_prefix_tree", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(*prefix_tree(turns.union(extra)))


def _secret_sql() -> str:
    """The scan in DuckDB: the same split-and-sum positions, and the links as
    existence tests."""
    pattern = {
        "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    } | {name: p for name, p, _, _ in KINDS[1:]}
    parts = " union all ".join(
        f"select rid, {i} as k, string_split_regex(t, '{pattern[name]}') as gaps, regexp_extract_all(t, '{pattern[name]}', 0) as hits, "
        f"regexp_extract_all(t, '{pattern[name]}', {group}) as part, {least} as least from d" for i, (name, _, group, least) in enumerate(KINDS))
    rank = {k[0]: i for i, k in enumerate(KINDS)}
    near = lambda *kinds: f"exists (select 1 from s b where b.rid = s.rid and abs(b.s - s.s) <= 512 and b.k in ({', '.join(str(rank[k]) for k in kinds)}))"
    names = "case k " + " ".join(f"when {i} then '{k[0]}'" for i, k in enumerate(KINDS)) + " end"
    line = f"{names} || ':' || s || ':' || e"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
m as ({parts}),
u as (select rid, k, least, unnest(range(1, len(hits) + 1)) as i, gaps, hits, part from m where len(hits) > 0),
p as (select rid, k, i, length(gaps[i]) as gap, length(hits[i]) as size,
        length(part[i]) >= least and (k <> {rank["token"]} or (regexp_matches(part[i], '[0-9]') and regexp_matches(part[i], '[A-Za-z]')
        and not regexp_matches(part[i], '[0-9a-f]{{16}}|AKIA[A-Z0-9]{{14}}'))) as good from u),
s as (select rid, k, s, s + size as e, good from (select *, sum(gap + size) over (partition by rid, k order by i) - size as s from p) where good),
r as (select * from s where k < 3 or (k = {rank["weak_id"]} and {near("assign", "hex", "token")})
        or (k = {rank["token"]} and {near("access", "weak_id", "endpoint")}) or (k = {rank["endpoint"]} and {near("access", "assign")})),
a as (select rid, count(*) filter (k = 0) as n0, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2,
        string_agg({line}, ',' order by s, k) filter (k < 3) as base, string_agg({line}, ',' order by s, k) as spans from r group by rid)
select doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)"""


def _joined(spans, keep=None):
    spans = F.filter(spans, lambda x: x["kind"].isin(*keep)) if keep else spans
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op2_secret_scan", _secret_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("spans"), BASE), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUALITY_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select rid, i, count(*) over (partition by rid, g) as c from (
        select rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w))),
r as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from g where c > 1) group by rid),
m as (select rid, doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(n, 0)::bigint as n_repeat_words, len(ls) as lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as upper,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as letters from w left join r using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (10 * n_symbols > n_words) and not (10 * n_dup_lines > 3 * lines)
       and not (word_chars < 2 * n_words or word_chars > 20 * n_words) and not (2 * upper > letters and letters > 40) as kept from b"""


@query("op8_quality_rules", QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = cascade(docs, metrics=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"), "kept")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


WORD_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
w as (select distinct item_id, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') as g from (
        select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from (select *, least(10, len(ws)) as n from i where len(ws) > 0))),
h as (select rid, p, n, item_id from (
        select rid, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') as g from (
            select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, (select distinct n from w) where len(ws) >= n)) join w using (n, g)),
c as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from h) group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, coalesce(item_id::varchar, '') as item from h) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join c using (rid) left join t using (rid)"""


@query("op4_benchmark_decontamination", CONTAMINATION_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SUBSTRING_SQL = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select rid, doc_id, p, substr(h, 2 * p + 1, 100) as g from (select rid, doc_id, h, unnest(range(0, length(h) // 2 - 49)) as p from d)),
m as (select rid, p, doc_id > min(doc_id) over (partition by g) as again from w),
s as (select rid, p, p + 50 as e from m where again),
r as (select rid, p, e, max(e) over (partition by rid order by p rows between unbounded preceding and 1 preceding) as b from s),
v as (select rid, min(p) as s, max(e) as e from (select *, sum(case when b is null or p > b then 1 else 0 end) over (partition by rid order by p) as k from r) group by rid, k),
g as (select rid, s, e, coalesce(lag(e) over (partition by rid order by s), 0) as b from v),
k as (select d.rid, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' order by s) || substr(any_value(h), 2 * max(e) + 1) as kept,
        sum(e - s) as n_removed, count(*) as n_spans from d join g using (rid) group by d.rid)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (rid)"""


@query("op6_suffix_dedup", SUBSTRING_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


PASSAGE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {WORD_SQL} as ws from documents),
w as (select rid, doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') as g from (select rid, doc_id, ws, unnest(range(1, len(ws) - 18)) as p from d)),
m as (select rid, p, row_number() over (partition by g order by doc_id, p) > 1 as again from w),
c as (select distinct rid, q from (select rid, unnest(range(p, p + 20)) as q from m where again)),
x as (select rid, q, ws[q] as word from (select rid, ws, unnest(range(1, len(ws) + 1)) as q from d)),
k as (select x.rid, string_agg(word, ' ' order by x.q) as kept, count(*) as n from x left join c on x.rid = c.rid and x.q = c.q where c.q is null group by x.rid)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (rid)"""


@query("op9_recompression_dedup", PASSAGE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


NEAR_SQL = f"""
with recursive d as (select row_number() over () as rid, doc_id, {WORD_SQL.replace("coalesce(text, '')", LOWER_SQL)} as ws from documents),
s as (select distinct rid, array_to_string(list_slice(ws, p, p + 4), ' ') as g from (select rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as p from d where len(ws) > 0)),
n as (select rid, count(*) as n from s group by rid),
l as (select a.rid as a, b.rid as b from s a join s b on a.g = b.g and a.rid < b.rid join n x on x.rid = a.rid join n y on y.rid = b.rid
        group by a.rid, b.rid, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e as (select a, b from l union all select b, a from l),
r(v, root) as (select rid, rid from n union select e.b, r.root from r join e on e.a = r.v),
c as (select v, min(doc_id) as component_id from r join d on d.rid = r.root group by v)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from d left join n using (rid) left join c on c.v = d.rid"""


@query("op10_minhash_near_dedup", NEAR_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op5_line_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_trie_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


RESAMPLE_SQL = rf"""
with t as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
d as (select row_number() over () as rid, doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
dw as (select rid, unnest(ws) as w from d),
bw as (select unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
h as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
y as (select w, list_transform(range(length(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) as bytes from h),
k as (select w, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as b from y, t),
s as (select b, count(*) as s from dw join k using (w) group by b),
g0 as (select b, count(*) as t from bw join k using (w) group by b),
a as (select (select count(*) from dw) as n_docs, (select count(*) from bw) as n_target),
g as (select b, floor(1000 * ln(((coalesce(g0.t, 0) + 1) * (n_docs + 10000))::double / ((coalesce(s.s, 0) + 1) * (n_target + 10000))::double)) as gain from s full join g0 using (b), a),
v as (select rid, count(*) as n, sum(gain) as total from dw join k using (w) join g using (b) group by rid),
z as (select rid, doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(total / n), 0)::bigint as weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join v using (rid)),
o as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from z),
r as (select rid, row_number() over (order by score desc, doc_id nulls last, rid) as rank, count(*) over () as n from o where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from o left join r using (rid)"""


@query("op12_importance_resampling", RESAMPLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, noisy scores and draw of all documents, towards ``benchmark``."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
