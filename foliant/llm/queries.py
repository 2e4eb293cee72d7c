"""The operators as queries over whole tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, written
from . import ann, best_fit_packing, chat_format, conversation_repair, decontaminate, edit_counts, fill_middle, license_scan, quality_resample, simhash_dedup, suffix_dedup, toxicity, url_filter

# The rules that op5 judges by, as (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.covered(table(spark, sf_dir, "documents"), 400))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op3_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_words", "log_weight", "gumbel_key")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), 2048)


def sample_edits(docs: DataFrame, n: int = 4) -> DataFrame:
    """`docs` with `n` edits each: places, lengths and inserted passages of the text itself, all drawn from hashes of the id."""
    draw = lambda i, what, most: F.pmod(F.xxhash64("doc_id", i, F.lit(what)), most).cast("int")
    size = F.length("text") + 1
    edit = lambda i: F.struct(draw(i, "at", size).alias("start"), draw(i, "cut", F.lit(60)).alias("removed"), F.substring(F.col("text"), draw(i, "from", size) + 1, draw(i, "put", F.lit(60))).alias("text"))
    return docs.withColumn("edits", F.transform(F.sequence(F.lit(1), F.lit(n)), edit))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = written(edit_counts.build(table(spark, sf_dir, "documents")))
    return edit_counts.apply(sample_edits(trees), keep=False)


def license_probes() -> list[tuple[int, str]]:
    """(id below 0, text) of each listed licence as it may be met: in capitals, on one line, behind a notice."""
    return [(-1 - i, "Copyright (c) 2024 Jane Doe. All rights reserved. " + " ".join(t.upper().split())) for i, (_, t) in enumerate(sorted(license_scan.LICENCES.items()))]


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and the probes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(license_probes(), "doc_id long, text string"))
    return license_scan.scan(docs, license_scan.known(spark))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and of every third a snapshot that was logged before its last turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    early = turns.where("conv_id % 3 = 0").join(last, "conv_id").where("turn < last").select((-1 - F.col("conv_id")).alias("conv_id"), "turn", "role", "text")
    return chat_format.render(turns.unionByName(early))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, one row in four damaged first."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.report(turns, conversation_repair.damaged(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_ann, op3_quality_resample, op4_simhash_dedup, op5_url_filter, op6_best_fit_packing, op7_edit_counts, op8_license_scan, op9_decontaminate, op10_chat_format, op11_toxicity, op12_fill_middle, op13_conversation_repair)}


def _sql_canonical() -> str:
    """The canonical form in SQL: words stand between two blanks each, so that whole words and phrases can be replaced."""
    mark, quoted = license_scan.MARK, lambda x: x.replace("'", "''")
    low = "lower(coalesce(text, ''))"
    stops = rf"regexp_replace(regexp_replace({low}, '[.!?](\S)', ' \1', 'g'), '(^|[^\p{{L}}\p{{N}}])({license_scan.SHORT})\.', '\1\2 ', 'g')"
    joined = rf"regexp_replace({stops}, '{license_scan.JOINED}', ' \1', 'g')"
    lines = rf"regexp_replace({joined}, '(?m)^[ \t#*/;-]*(?:{mark})[^\n]*$', ' ', 'g')"
    head = rf"regexp_replace({lines}, '^\s*copyright [^\n]*\n', ' ')"
    bare = f"CASE WHEN contains({low}, 'copyright') OR contains({low}, '(c)') OR contains({low}, '©') THEN {head} ELSE {low} END"
    text = rf"' ' || replace(trim(regexp_replace({bare}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' '"
    one = [(x, y) for x, y in license_scan.SPELLINGS if " " not in x]
    for spelling, by in [*one, (license_scan.RESERVED, ""), *(x for x in license_scan.SPELLINGS if x not in one)]:
        text = f"replace({text}, ' {quoted(spelling).replace(' ', '  ')} ', ' {by} ')"
    return f"trim(regexp_replace({text}, ' +', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({', '.join(map(quoted, r))})" for r in URL_RULES)
    titled = [(k, f"{t}\n\n{license_scan.LICENCES[k]}") for k, t in license_scan.TITLES.items()]
    listed = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in [*license_scan.LICENCES.items(), *titled])
    digests = ", ".join(f"({quoted(v)}, {quoted(k)})" for k, v in license_scan.DIGESTS.items())
    probes = ", ".join(f"({i}, {quoted(t)})" for i, t in license_probes())
    canonical = _sql_canonical()
    return {
        "op5_url_filter": rf"""
            WITH rules(host, path, verdict) AS (VALUES {rules}),
            p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
            h AS (SELECT u.page_id, rules.host || rules.path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rules.host) + length(rules.path) DESC) AS k
                  FROM u JOIN rules ON (u.host = rules.host OR suffix(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path))
            SELECT u.page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN h ON u.page_id = h.page_id AND k = 1""",
        "op8_license_scan": f"""
            WITH listed AS (SELECT sha256({canonical}) AS digest, license_id FROM (VALUES {listed}) AS t(license_id, text) UNION ALL VALUES {digests}),
            known AS (SELECT digest, min(license_id) AS license_id FROM listed GROUP BY digest),
            every AS (SELECT doc_id, text FROM documents UNION ALL VALUES {probes}),
            d AS (SELECT doc_id, nullif({canonical}, '') AS body FROM every)
            SELECT doc_id, sha256(body) AS digest, license_id FROM d LEFT JOIN known ON sha256(body) = digest""",
        "op12_fill_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
            u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
            c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
            p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:n], '') AS suffix,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM p""",
        "op10_chat_format": """
            WITH every AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
                SELECT -1 - conv_id, turn, role, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE conv_id % 3 = 0 AND turn < last),
            t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM every WHERE conv_id IS NOT NULL),
            c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l,
                  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat FROM t GROUP BY conv_id),
            k AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l)
            SELECT c.conv_id, c.n AS n_turns, k.copies, c.chat FROM k JOIN c ON c.conv_id = k.conv_id
            WHERE NOT EXISTS (SELECT 1 FROM c d WHERE len(d.l) > len(k.l) AND d.l[1:len(k.l)] = k.l)""",
    }
