"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoopwise.llm import ann, bpe, exact_dedup, langid, mixing, ngram_join, packing, passages, phrases, pseudonyms, repair, secrets, toxicity
from stoopwise.llm.common import crc_remainder

SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number and digest of ids, digest of the decoded bytes."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary(spark))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs, learnt=crc_remainder("doc_id", 4) != 2)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that repeats a passage of an earlier one, and where it does."""
    found = passages.repeats(_table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_spans"),
        "removed_chars",
        F.array_join(spans, ",").alias("spans"),
        "kept_in",
    )


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its source's target and the words that the mix takes of it."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the one that stays of its equal texts."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)


SQL["op6_exact_dedup"] = r"""
WITH bodies AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM bodies
"""


def toxicity_scorer(docs: DataFrame, labels: DataFrame) -> toxicity.Scorer:
    return toxicity.learn(docs, labels, learnt=crc_remainder("doc_id", 5) != 0)


# A key for runs over test data; a real one comes from a secret store.
DEMO_KEY = "demonstration key"


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data permuted, and how many values of each kind."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, DEMO_KEY)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scorer(docs, _table(spark, sf_dir, "labels")).score(docs)
    return scored.select("row.doc_id", "score").select(
        "doc_id",
        (crc_remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its class of near copies and the number of its links."""
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base kinds, all spans."""
    return secrets.digests(secrets.scanned(_table(spark, sf_dir, "documents")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence of 4096 tokens."""
    import public_tokenizers

    tokenizer = packing.tokenizer_source(public_tokenizers.path("word_bpe_49k.json"))
    return packing.digests(packing.packed(_table(spark, sf_dir, "documents"), tokenizer))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest edits, the repaired turns' digest."""
    conversations = _table(spark, sf_dir, "conversations")
    return repair.summaries(conversations, repair.damaged(repair.messages(conversations)))


def _step(state: int, cost: str, letter: str, more: str = "") -> str:
    """An edit of the twin: a state's cheapest edits with one more."""
    said = f"(s{state}).r || chr(10) || {more}" if more else f"(s{state}).r"
    return f"{{'c': (s{state}).c + {cost}, 'a': (s{state}).a || '{letter}', 'r': {said}}}"


def _op12_sql() -> str:
    """A recursive twin: per row and state the least (cost, initials), inserts closed after each row."""
    never = "{'c': 1000000000, 'a': 'Z', 'r': ''}"
    dropped = [_step(q, "3", "D") for q in range(4)]
    reroled = [f"CASE WHEN gone THEN {never} ELSE {_step(q, '2 + open_end', 'R', who)} END" for q, who in enumerate(["'user:' || text"] * 2 + ["'assistant:' || text", "'user:' || text"])]
    kept = [f"CASE WHEN gone OR initial <> '{{}}' THEN {never} ELSE {_step(q, 'open_end', 'K', 'role || chr(58) || text')} END" for q in range(4)]
    rows = {
        0: dropped[0],
        1: f"least({dropped[1]}, {kept[0].replace('{}', 's')})",
        2: f"least({', '.join([dropped[2], *(reroled[q] for q in (0, 1, 3)), *(kept[q].replace('{}', 'u') for q in (0, 1, 3))])})",
        3: f"least({dropped[3]}, {reroled[2]}, {kept[2].replace('{}', 'a')})",
    }
    user, assistant = "'user:'", "'assistant:'"
    to_user = ", ".join(["s2", *(_step(q, "2", "I", user) for q in (0, 1, 3))])
    return rf"""
WITH RECURSIVE read AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), sums AS (
    SELECT *, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
            lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)
    ), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM read
), damaged AS (
    SELECT conv_id, turn,
           CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM sums WHERE kind <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged
), faults AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
           NOT regexp_matches(text, '[^ 	-
]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS cut,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM numbered
), marked AS (
    SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again AND cut AS BIGINT) AS open_end FROM faults
), walked AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {never} AS s1,
           {{'c': 2, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2,
           {{'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
    FROM (SELECT DISTINCT conv_id FROM marked)
    UNION ALL
    SELECT conv_id, i, s0, s1, s2, least(s3, {_step(2, "2", "I", assistant)}) FROM (
        SELECT conv_id, i, s0, s1, least({to_user}) AS s2, s3 FROM (
            SELECT w.conv_id, m.i, {rows[0]} AS s0, {rows[1]} AS s1, {rows[2]} AS s2, {rows[3]} AS s3
            FROM walked w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
        )
    )
), ended AS (
    SELECT conv_id, arg_max(least(s0, s3), i) AS best FROM walked GROUP BY conv_id
), counted AS (
    SELECT conv_id,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank,
           count(*) FILTER (again AND NOT blank) AS duplicate,
           CAST(sum(open_end) AS BIGINT) AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce((best).c, 0) AS BIGINT) AS cost, coalesce((best).a, '') AS audit,
       sha256(coalesce(substr((best).r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL["op12_repair"] = _op12_sql()


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best scoring phrases of each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


SQL["op13_phrases"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM words GROUP BY lang
), places AS (
    SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
    FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), counts AS (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
    FROM places GROUP BY ALL
), candidates AS (
    SELECT lang, k, phrase, f AS a FROM counts WHERE k >= 2 AND f >= 100
), kept AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates d
        WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
          AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS cut FROM kept
), scores AS (
    SELECT c.lang, c.phrase, c.a, cut, h.f AS l, t.f AS r, n, (1000 * c.a * n) // (h.f * t.f) AS score
    FROM cuts c JOIN totals USING (lang)
    JOIN counts h ON h.lang = c.lang AND h.k = cut AND h.phrase = array_to_string(words[1:cut], ' ')
    JOIN counts t ON t.lang = c.lang AND t.k = c.k - cut AND t.phrase = array_to_string(words[cut + 1:], ' ')
), least AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the corpus pipeline's last stage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bpe, op2_nearest, op3_language, op4_passages, op5_mix, op6_exact_dedup, op7_pseudonyms, op8_toxicity, op9_ngram_join, op10_secrets, op11_packing, op12_repair, op13_phrases, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
