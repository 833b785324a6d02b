"""The registered queries: each operator over its whole table."""

from pyspark.sql import functions as F

from voxloom.llm import (
    dialogues,
    language_id,
    language_model,
    mixing,
    nearest,
    packing,
    pieces,
    quality_model,
    repeats,
    simhash,
    tokens,
    url_rules,
    whitening,
)
from voxloom.llm.shared import id_remainder, table
from voxloom.session import stored

THRESHOLD = 0.7

QUERIES, ORACLES = {}, {}


def registered(sql=None):
    def register(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql.strip()
        return query

    return register


def due_sql(share, knots):
    """SQL of the time at which a schedule's integral reaches a share of its whole."""
    def number(x):
        return f"CAST('{x!r}' AS DOUBLE)"

    pairs = list(zip(knots, knots[1:], strict=False))
    areas = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in pairs]
    whole, cases = sum(areas), []
    for n, ((t0, m0), (t1, m1)) in enumerate(pairs):
        low, slope = sum(areas[:n]) / whole, (m1 - m0) / (t1 - t0)
        rest = f"greatest(({share} - {number(low)}) * {number(whole)}, {number(0.0)})"
        root = f"sqrt(greatest({number(m0 * m0)} + {number(2 * slope)} * {rest}, {number(0.0)}))"
        time = f"{number(t0)} + 2 * {rest} / ({number(m0)} + {root})"
        cases.insert(0, f"WHEN {share} >= {number(low)} AND {rest} > 0 THEN {time}")
        cases.insert(1, f"WHEN {share} >= {number(low)} THEN {number(t0)}")
    return f"least(CASE {' '.join(cases)} END, {number(1.0)})"


DUE = " ".join(
    f"WHEN {turn} THEN {due_sql('share', knots)}" for turn, knots in enumerate(mixing.SCHEDULES)
)


@registered(f"""
WITH docs AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS k,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
sources AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY k) - 1) % 3 AS turn,
    CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN CAST(5 AS DOUBLE)
      WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w
  FROM docs GROUP BY k),
filled AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS ceiling,
    (CAST((SELECT sum(source_size) FROM sources) AS DOUBLE)
      - coalesce(sum(CAST(3 * source_size AS DOUBLE)) OVER before, CAST(0 AS DOUBLE)))
      / sum(w) OVER after AS level
  FROM sources
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, k
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT k, source_size, turn, least(ceiling, (SELECT max(level) FROM filled) * w) AS target
  FROM filled),
placed AS (
  SELECT doc_id, size, source_size, target, turn,
    CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM docs JOIN targets USING (k)),
due AS (
  SELECT *, list_transform(
      list_filter([0, 1, 2], lambda e: start + e * source_size + CAST(size AS DOUBLE) / 2 < target),
      lambda e: CAST(start + e * source_size AS DOUBLE) / target) AS shares
  FROM placed),
timed AS (
  SELECT *, list_transform(shares, lambda share: CASE turn {DUE} END * words) AS positions
  FROM due, (SELECT CAST(sum(source_size) AS DOUBLE) AS words FROM sources))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * len(positions) AS BIGINT) AS taken,
  positions[1] AS position_1, positions[2] AS position_2, positions[3] AS position_3
FROM timed
""")
def op1_mixing(spark, sf_dir):
    """Every document with the words the mix takes of it and its copies' training positions."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("__size"))
    planned = mixing.plan_mix(stored(sized, "sizes"))
    return mixing.in_order(planned).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.size("__positions")).alias("taken"),
        *[
            F.get("__positions", F.lit(n)).alias(f"position_{n + 1}")
            for n in range(mixing.MOST_REPEATS)
        ],
    )


@registered()
def op2_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("__fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@registered()
def op3_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    remainder = id_remainder("doc_id", 4)
    scored = quality_model.score(docs, labels, remainder != 2)
    return scored.select(
        "doc_id",
        (remainder == 2).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


SITES = ", ".join(
    f"({n}, '{verdict}', '{host}', '{path}')"
    for n, (verdict, host, path) in enumerate(url_rules.SITE_RULES)
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@registered(f"""
WITH sites(n, verdict, host, path) AS (VALUES {SITES}),
parts AS (
  SELECT page_id, url, row_number() OVER () AS row,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
      '{UPPER}', '{UPPER.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fitting AS (
  SELECT p.row, arg_max(concat(s.host, s.path), length(s.host) + length(s.path)) AS rule,
    arg_max(s.verdict, length(s.host) + length(s.path)) AS verdict
  FROM parts p JOIN sites s
    ON (p.host = s.host OR ends_with(p.host, concat('.', s.host))) AND starts_with(p.path, s.path)
  GROUP BY p.row)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(p.host,
    '(^|[.])((ads|adult|casino|spam)-[a-z0-9]+|cheap-pills|free-bets)[.]')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fitting f ON p.row = f.row
""")
def op4_url_rules(spark, sf_dir):
    """Verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_rules.judge_urls(pages).drop("url")


@registered()
def op5_packing(spark, sf_dir):
    """Place of every piece of every document in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.cut_pieces(docs, tokens.vocabulary_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@registered()
def op6_token_counts(spark, sf_dir):
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.count_tokens(docs, tokens.vocabulary_path())


@registered()
def op7_quality_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = repeats.judge(docs)
    names = [*repeats.COUNTS, "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"__{name}").alias(name) for name in names])


@registered("""
WITH vectors AS (
  SELECT vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (
  SELECT vec_id AS query_id, min(vector) AS query FROM vectors
  WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (
  SELECT query_id, vec_id, CAST(list_inner_product(CAST(query AS DOUBLE[]),
    CAST(vector AS DOUBLE[])) AS BIGINT) AS score
  FROM asked JOIN vectors ON vec_id <> query_id AND len(vector) = len(query))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""")
def op8_top_k(spark, sf_dir):
    """Ten best vectors of every vector whose id is divisible by 100."""
    return nearest.search_table(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@registered()
def op9_language_model(spark, sf_dir):
    """Base score and model score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = language_model.score(docs, id_remainder("doc_id", 5) != 1)
    return scored.withColumn("held_out", ~F.col("training")).drop("training")


@registered()
def op10_language_id(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    remainder = id_remainder("doc_id", 5)
    return language_id.identify(docs, remainder != 0).select(
        "doc_id",
        (remainder == 0).alias("held_out"),
        F.col("__lang_pred").alias("lang_pred"),
        F.col("__score").alias("score"),
    )


@registered()
def op11_whitening(spark, sf_dir):
    """Whitened coordinates of every usable vector on the first 16 components."""
    vectors = whitening.whole_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return whitening.whiten(vectors)


def damaged(conversations):
    """Conversations with faults planted by a hash of their id and turn."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
    return (
        dialogues.plain_rows(conversations)
        .withColumn("fault", F.crc32(F.concat_ws(":", *parts)) % 20)
        .filter(fault != 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))))
        .select(
            "conv_id", "turn",
            F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
            text.otherwise(F.col("text")).alias("text"),
        )
    )


@registered()
def op12_conversations(spark, sf_dir):
    """Faults, cheapest repair and digest of every conversation."""
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = damaged(given)
    solved = dialogues.repair(rows)
    hashes = dialogues.text_hashes(dialogues.repaired_rows(rows, solved))
    found = [
        frame.withColumnRenamed("conv_id", name)
        for frame, name in ((dialogues.reports(solved), "of"), (hashes, "by"))
    ]
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in dialogues.REPORT]
    return (
        given.select("conv_id").distinct()
        .join(found[0], F.col("conv_id").eqNullSafe(F.col("of")), "left")
        .join(found[1], F.col("conv_id").eqNullSafe(F.col("by")), "left")
        .select(
            "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


@registered()
def op13_pieces(spark, sf_dir):
    """Count and digest of every document's piece ids, and digest of what they decode to."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = pieces.encode_texts(docs, tokens.vocabulary_path(pieces.MODEL), decoded=True)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
