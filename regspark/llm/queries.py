"""The queries of this folder, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("removed").alias("n_spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    return find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    held = crc_mod("doc_id", 7) == 2
    out = score(table(spark, sf_dir, "documents", "doc_id", "text"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), crc_mod("doc_id", 3) != 1)
    return toxicity.score(docs, model, limit=0.7).withColumn("held_out", crc_mod("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted", "worst_score", "worst_start", "worst_end")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


#: Verdicts by host and path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_lm_scoring, op4_toxicity, op5_token_counts, op6_packing, op7_quality_rules, op8_url_filters, op9_minhash_near_dedup, op10_suffix_array_dedup)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: The results that SQL can state, over whole tables.
ORACLES = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, a, md5(array_to_string(ws[a:a + 49], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS a FROM w WHERE len(ws) >= 50)),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, a + j AS place FROM (SELECT doc_id, a FROM win JOIN first USING (s) WHERE f < doc_id), (SELECT unnest(range(50)) AS j)),
per AS (SELECT doc_id, list(place) AS gone, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM place - 1) AS spans FROM (SELECT doc_id, place, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM gone) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]), ' ') END) AS kept_sha256, coalesce(spans, 0)::INTEGER AS n_spans
FROM w LEFT JOIN per USING (doc_id)""",
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS p FROM d)),
ish AS (SELECT item_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT item_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS p FROM i)),
ic AS (SELECT item_id, n AS l, s, count(*) AS c FROM ish GROUP BY ALL),
met AS (SELECT doc_id, item_id, ds.n, l, ds.p, ds.s, c FROM ds JOIN ic USING (s)),
win AS (SELECT doc_id, item_id, n, l, unnest(range(0, greatest(n - l, 0) + 1)) AS start FROM (SELECT DISTINCT doc_id, item_id, n, l FROM met)),
ws AS (SELECT win.doc_id, win.item_id, win.n, win.l, start, s, least(count(*), max(c)) AS c FROM win JOIN met ON win.doc_id = met.doc_id AND win.item_id = met.item_id AND p BETWEEN start AND start + least(win.n, win.l) - 5 GROUP BY ALL),
sums AS (SELECT doc_id, item_id, n, l, start, sum(c) AS common FROM ws GROUP BY ALL),
sim AS (SELECT doc_id, item_id, l, start, (common / (least(n, l) - 4 + l - 4 - common))::DOUBLE AS similarity FROM sums)
SELECT doc_id, item_id, similarity, start::INTEGER AS start, l::INTEGER AS n_words FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
    "op10_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, f, substr(h, 2 * f + 1, 2 * (256 + 199)) AS p FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 256)) AS f FROM d)),
win AS (SELECT doc_id, f + i AS a, md5(substr(p, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, f, p, unnest(range(0, least(256, length(p) // 2 - 199))) AS i FROM part)),
hit AS (SELECT doc_id, a, lag(a) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
run AS (SELECT doc_id, a, count(*) FILTER (before IS NULL OR a > before + 200) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM hit),
span AS (SELECT doc_id, k, min(a) AS x, max(a) + 200 AS z FROM run GROUP BY ALL),
gap AS (SELECT doc_id, k, x, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS f FROM span),
per AS (SELECT doc_id, sum(z - x) AS gone, count(*) AS n, max(z) AS last, string_agg(substr(h, 2 * f + 1, 2 * (x - f)), '' ORDER BY k) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)""",
    "op9_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (an + bn - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS doc, doc_id AS top FROM sh UNION SELECT sym.b, reach.top FROM reach JOIN sym ON reach.doc = sym.a),
comp AS (SELECT doc AS doc_id, min(top) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sh JOIN comp USING (doc_id)""",
}


#: Levels that the SQL states; the operator takes as many as there are. The tables' paths have four segments at most.
URL_SQL_LEVELS = 6


def _url_sql() -> str:
    hosts = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    sql = f"""
WITH p AS (SELECT page_id, {hosts} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(2)} AS said, list_transform(string_split(ltrim(path, '/'), '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE '=' || s END) AS segs FROM p),
t0 AS MATERIALIZED (SELECT host, segs, count(*) FILTER (said = 'allow')::DOUBLE AS good, count(*) FILTER (said = 'block')::DOUBLE AS bad, ''::VARCHAR AS node FROM r GROUP BY ALL)"""
    for d in range(URL_SQL_LEVELS):
        sql += f""",
k{d} AS (SELECT host, node, segs[{d + 1}] AS seg, sum(good) AS g, sum(bad) AS b FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
e{d} AS (SELECT host, node, g, b, count(*) AS kids FROM k{d} WHERE seg <> '*' AND g + b >= 5 GROUP BY ALL),
c{d} AS (SELECT *, lag(g) OVER w AS pg, lag(b) OVER w AS pb FROM e{d} WINDOW w AS (PARTITION BY host, node ORDER BY g / (g + b), g, b)),
z{d} AS (SELECT host, node, g, b, kids, count(*) FILTER (pg IS NOT NULL AND abs(g / (g + b) - pg / (pg + pb)) > 1.96 * sqrt((g + pg) / (g + b + pg + pb) * (1 - (g + pg) / (g + b + pg + pb)) * (1 / (g + b) + 1 / (pg + pb)))) OVER (PARTITION BY host, node ORDER BY g / (g + b), g, b) AS k FROM c{d}),
y{d} AS (SELECT *, sum(kids) OVER (PARTITION BY host, node, k) AS alike FROM z{d}),
n{d} AS (SELECT k{d}.host, k{d}.node, seg, CASE WHEN seg = '*' OR y{d}.k IS NULL THEN '*' WHEN alike = 1 THEN seg ELSE '~' || y{d}.k END AS new FROM k{d} LEFT JOIN y{d} ON k{d}.host = y{d}.host AND k{d}.node = y{d}.node AND k{d}.g = y{d}.g AND k{d}.b = y{d}.b AND seg <> '*'),
t{d + 1} AS MATERIALIZED (SELECT t.host, t.segs, t.good, t.bad, CASE WHEN x.seg IS NULL THEN t.node ELSE t.node || '/' || x.new END AS node FROM t{d} t LEFT JOIN n{d} x ON t.host = x.host AND t.node = x.node AND t.segs[{d + 1}] = x.seg)"""
    return sql + f""",
u AS (SELECT host, node, (sum(good) + 1) / (sum(good) + sum(bad) + 2) AS purity FROM t{URL_SQL_LEVELS} GROUP BY ALL)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN purity < 0.25 THEN 'block' ELSE 'allow' END) AS verdict, f.node AS template, purity
FROM r JOIN t{URL_SQL_LEVELS} f ON r.host = f.host AND r.segs = f.segs JOIN u ON f.host = u.host AND f.node = u.node"""


ORACLES["op8_url_filters"] = _url_sql()
