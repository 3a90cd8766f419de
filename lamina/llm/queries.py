"""The corpus operators as queries over the driver tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import (
    decontaminate,
    divergence,
    language_id,
    lpf_dedup,
    mixing,
    order_minhash,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_counts,
    url_filter,
    warc,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    tests = " AND ".join(f"{r.metric} BETWEEN {r.low} AND {r.high}" for r in quality_rules.RULES)
    first = "CASE " + " ".join(
        f"WHEN {r.metric} NOT BETWEEN {r.low} AND {r.high} THEN '{r.metric}'" for r in quality_rules.RULES
    ) + " END"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH t AS (
      SELECT doc_id, coalesce(text, '') AS text,
             list_filter(string_split(translate(coalesce(text, ''), {spaces}, '      '), ' '), lambda w: w <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: translate(x, {spaces}, '') <> '') AS l
      FROM documents),
    g AS (
      SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
             unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
      FROM t WHERE len(w) >= 3),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
    covered AS (
      SELECT doc_id, count(*) AS n
      FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY doc_id),
    counts AS (
      SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(translate(text, {spaces}, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words
      FROM t LEFT JOIN covered USING (doc_id)),
    ratios AS (
      SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars,
             n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
             n_stop_words / greatest(n_words, 1)::DOUBLE AS stop_ratio,
             n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
             n_words / greatest(n_lines, 1)::DOUBLE AS mean_line_words,
             n_words < {quality_rules.BASE_MIN_WORDS}
               OR 100 * n_repeat_words > {quality_rules.BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM counts)
    SELECT *, {first} AS failed_rule, NOT base_failed AND {tests} AS kept FROM ratios
    """


@register("op1_quality_rules", _rules_sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public byte-level vocabulary."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as 0 of nothing."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(_remainder(3) != 1))
    found = language_id.predict(docs, net)
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    found = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    return found.select(
        "doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@register("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@register("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.taken(table(spark, sf_dir, "documents"))


@register("op4_order_minhash")
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents"))


@register("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row per pair."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document less those of strings that start earlier."""
    return lpf_dedup.remove(table(spark, sf_dir, "documents"))


def _urls_sql() -> str:
    u = url_filter
    fits = lambda of, begin: f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{begin}')"
    longest = sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(o, b)} THEN '{o}{b}'" for _, o, b in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(o, b)} THEN '{v}'" for v, o, b in longest) + " END"
    counts = "count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0) AS blocked"
    shape = "CASE " + " ".join(f"WHEN regexp_matches(seg, '{p}') THEN '{n}'" for n, p in u.SHAPES) + f" ELSE '{u.OTHER_SHAPE}' END"
    pool = lambda own, n, all_own, all_n: (
        f"""abs({own} / greatest({n}, 1)::DOUBLE - ({all_own} - {own}) / greatest({all_n} - {n}, 1)::DOUBLE)
            <= {u.ALIKE}::DOUBLE * sqrt((({all_own} + 0.5::DOUBLE) / ({all_n} + 1.0::DOUBLE))
              * (1.0::DOUBLE - ({all_own} + 0.5::DOUBLE) / ({all_n} + 1.0::DOUBLE))
              * (1.0::DOUBLE / greatest({n}, 1) + 1.0::DOUBLE / greatest({all_n} - {n}, 1)))"""
    )
    steps = ["""
    r0 AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts, '' AS template, '' AS above FROM labels_)"""]
    for k in range(u.DEPTH):
        steps.append(f"""
    s{k} AS (SELECT host, template, parts[{k + 1}] AS seg, {counts}, count(*) FILTER (WHERE len(parts) = {k + 1}) AS ended,
               count(*) FILTER (WHERE regexp_matches(parts[{k + 2}], '^[0-9]')) AS digits
             FROM r{k} WHERE len(parts) > {k} GROUP BY ALL),
    n{k} AS (SELECT host, template, sum(n) AS n_, sum(labelled) AS labelled_, sum(blocked) AS blocked_
             FROM s{k} GROUP BY ALL),
    h{k} AS (SELECT *, {shape} AS shape, CASE WHEN ended * 2 > n THEN '$' WHEN digits * 2 > n THEN '9' ELSE '{u.OTHER_SHAPE}' END AS below
             FROM s{k} JOIN n{k} USING (host, template)
             WHERE n >= {u.LEAST} AND (n >= {u.SHARE}::DOUBLE * n_ OR n >= {u.MANY})),
    f{k} AS (SELECT host, template, shape, below, sum(n) AS an, sum(ended) AS ae, sum(digits) AS ad
             FROM h{k} WHERE labelled < {u.LABELLED} GROUP BY ALL),
    k{k} AS (
      SELECT host, template, seg, CASE
          WHEN labelled >= {u.LABELLED} THEN CASE WHEN labelled_ - labelled >= {u.LABELLED}
            AND {pool("blocked", "labelled", "blocked_", "labelled_")} THEN '{u.WILD}' || shape || '{u.LABELLED_GROUP}' ELSE seg END
          WHEN an > n AND {pool("ended", "n", "ae", "an")} AND {pool("digits", "n", "ad", "an")} THEN '{u.WILD}' || shape || below
          ELSE seg END AS step
      FROM h{k} LEFT JOIN f{k} USING (host, template, shape, below)),
    r{k + 1} AS (
      SELECT r.* EXCLUDE (seg) REPLACE (
        CASE WHEN seg IS NULL THEN r.above ELSE r.template END AS above,
        r.template || CASE WHEN seg IS NULL THEN '' ELSE '/' || coalesce(step, '{u.WILD}' || {shape}) END AS template)
      FROM (SELECT *, parts[{k + 1}] AS seg FROM r{k}) r LEFT JOIN k{k} k USING (host, template, seg))""")
    return f"""
    WITH parsed_ AS (
      SELECT page_id,
             translate(regexp_extract(coalesce(url, ''), '{u.URL}', 1), '{u.UPPER}', '{u.LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '{u.URL}', 2) AS path FROM pages),
    ruled_ AS (SELECT *, {rule} AS rule, {verdict} AS said FROM parsed_),
    labels_ AS (SELECT *, CASE WHEN said IS NOT NULL THEN CAST(said = 'block' AS BIGINT) END AS label FROM ruled_),
    {",".join(steps)},
    placed AS (SELECT * REPLACE (CASE WHEN len(parts) > {u.DEPTH} THEN template ELSE above END AS above,
                                 template || CASE WHEN len(parts) > {u.DEPTH} THEN '/**' ELSE '' END AS template)
               FROM r{u.DEPTH}),
    counted AS (SELECT host, above, template, {counts} FROM placed GROUP BY ALL),
    passing AS (
      SELECT host, n, labelled, blocked, unnest(list_transform(range(1, greatest(len(t), 2)), lambda k: array_to_string(t[1:k], '/'))) AS above
      FROM (SELECT *, string_split(template, '/') AS t FROM counted)),
    nodes AS (SELECT host, above, (sum(blocked) + 0.5::DOUBLE * (sum(n) - sum(labelled))) / sum(n) AS prior FROM passing GROUP BY ALL),
    pure AS (SELECT host, template, (blocked + {u.SMOOTH}::DOUBLE * prior) / (labelled + {u.SMOOTH}::DOUBLE) AS purity
             FROM counted JOIN nodes USING (host, above))
    SELECT page_id, host, path, rule, template, purity,
           coalesce(said, CASE WHEN purity >= {u.PURE} THEN 'block' ELSE 'allow' END) AS verdict
    FROM placed JOIN pure USING (host, template)
    """


@register("op2_url_filter", _urls_sql())
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def _divergence_sql() -> str:
    d = divergence
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // {q}"
    share = lambda c, n: f"1 + {d.UNIT}::HUGEINT * ({c} + 1) // ({n} + v)"
    rank = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents),
    vectors AS (
      SELECT i, lang, source, term, count(*) AS c
      FROM (SELECT i, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
    kept AS (SELECT lang, term, sum(c) AS total FROM vectors GROUP BY ALL HAVING count(*) >= {d.LEAST_DOCS}),
    sums AS (SELECT lang, source, term, sum(c) AS c FROM vectors JOIN kept USING (lang, term) GROUP BY ALL),
    sizes AS (
      SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(all_n), 0) AS all_n, coalesce(sum(c), 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source)
        LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY ALL) USING (lang)
      GROUP BY lang, source),
    dense AS (
      SELECT lang, source, term, coalesce(c, 0) AS c, {share("coalesce(c, 0)", "n")} AS p, {share("total", "all_n")} AS q
      FROM sizes JOIN kept USING (lang) LEFT JOIN sums USING (lang, source, term)),
    pairs AS (
      SELECT s.lang, s.source, t.source AS item, CAST(coalesce(sum({f("a.p", "b.p")}), 0) AS BIGINT) AS value
      FROM sizes s JOIN sizes t ON s.lang = t.lang AND s.source <> t.source
        LEFT JOIN dense a ON a.lang = s.lang AND a.source = s.source
        LEFT JOIN dense b ON b.lang = t.lang AND b.source = t.source AND b.term = a.term
      GROUP BY ALL),
    over AS (SELECT lang, source, term AS item, CAST({f("p", "q")} AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value, {rank} FROM pairs
    UNION ALL
    SELECT lang, source, 'term' AS part, item, value, rank FROM (SELECT *, {rank} FROM over) WHERE rank <= {d.MOST_TERMS}
    """


@register("op11_source_divergence", _divergence_sql())
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms that mark each source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def _warc_sql() -> str:
    """Digests in base 32 from the bits of DuckDB's hexadecimal ones."""
    five = " + ".join(f"{16 >> k} * CAST(substr(bits, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INTEGER)" for k in range(5))
    return f"""
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS html, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits
      FROM pages),
    firsts AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {five}, 1)), '')
             AS payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM p JOIN firsts USING (html)
    """


@register("op12_warc", _warc_sql())
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to archives and read back."""
    pages = table(spark, sf_dir, "pages")
    archives = warc.write(pages, warc.new_folder(spark), least_bytes=0)
    found = warc.records(warc.read(archives, payload=False))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))
