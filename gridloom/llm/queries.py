"""The registered queries of this subpackage, and their SQL where SQL can say it.

Each query applies its operator, with production parameters, to whole tables and derives the
contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import collocations, conversation_repair, dart_minhash, decontaminate, html_extract, line_dedup, mixing, quality_classifier, quality_rules, secrets, suffix_tree, token_counts, toxicity
from gridloom.llm.text import is_fold, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: secret scan -------------------------------------------------------------


@register("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def digest(findings):
        return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"] != "novel")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("findings")).alias("spans"), count("novel"),
    )


# --- 2: toxicity ----------------------------------------------------------------

#: Score from which a document counts as toxic.
TOXIC = 0.7


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_hits", "n_misspelled",
    )


# --- 3: line dedup --------------------------------------------------------------


@register("op3_line_dedup")
def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lists = line_dedup.drop_lists(line_dedup.line_classes(docs, exact_from=1))
    theirs = lists.withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_own"))
    both = keyed.join(theirs, keyed["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_own") == F.col("_h")), "left")
    none = F.lit(0).cast("long")
    classes = F.transform("classes", lambda x: F.concat_ws(":", x["place"], x["class_id"], x["copies"], x["links"]))
    return both.select(
        "doc_id", F.coalesce("n_lines", none).alias("n_lines"), F.coalesce("n_repeated", none).alias("n_repeated"),
        F.coalesce(F.size("drop").cast("long"), none).alias("n_dropped"), F.coalesce(F.array_join("drop", ","), F.lit("")).alias("dropped"),
        # place:class:copies:links of each repeated line
        F.coalesce(F.array_join(classes, ","), F.lit("")).alias("classes"),
    )


# --- 4: token counts -------------------------------------------------------------

#: The vocabulary of the contract, and its budget.
VOCABULARY = "word_bpe_49k.json"
BUDGET = 2048


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    vocabulary = token_counts.read_vocabulary(vocabulary_path())
    return token_counts.budget_answers(table(spark, sf_dir, "documents"), vocabulary, BUDGET)


# --- 5: benchmark decontamination -----------------------------------------------

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
grams AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
    FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT r, i, grams.m, item_id FROM grams JOIN win ON grams.g = win.g AND grams.m = win.m),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""


@register("op5_decontamination", LEAKS_SQL)
def op5_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


# --- 6: near-duplicates ---------------------------------------------------------


@register("op6_dart_minhash")
def op6_dart_minhash(spark, sf_dir):
    found = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "keeper")


# --- 7: mixing ------------------------------------------------------------------

MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{mixing.SEED}') AS k FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, source_size * {mixing.MAX_EPOCHS} AS cap,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM per_source),
ranked AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS i FROM weighed),
shared AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT)
    - coalesce(CAST(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest,
    CAST(sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS o FROM ranked),
rate AS (SELECT rest AS r, o AS q FROM shared WHERE cap * o >= rest * w ORDER BY i LIMIT 1),
wanted AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), CAST(r * w AS DOUBLE) / q) AS target,
    least(cap, (r * w) // q) AS budget FROM shared, rate),
placed AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos FROM sized),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS e FROM wanted)
SELECT p.doc_id, p.size, e.source_size, e.target,
    e.e * p.size + least(greatest(e.budget - e.e * e.source_size - p.pos, 0), p.size) AS taken, p.source
FROM placed p JOIN epochs e ON p.source IS NOT DISTINCT FROM e.source
"""


@register("op7_mixing", MIX_SQL)
def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


# --- 8: quality rules -----------------------------------------------------------

RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + j AS p FROM rep, (VALUES (0), (1), (2)) v(j)) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
nx AS (SELECT r, count(*) AS n_same_next FROM (SELECT r, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 2)
    WHERE w[i] = w[i + 1] GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_ascii_letters,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks,
    coalesce(n_same_next, 0) AS n_same_next
    FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN nx USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR (n_ascii_letters >= 20 AND 2 * n_upper > n_ascii_letters)
    OR 10 * n_same_next > 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_digits > word_chars OR 5 * n_marks > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""


@register("op8_quality_rules", RULES_SQL)
def op8_quality_rules(spark, sf_dir):
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes_policy("v1")).alias("base_failed"),
        quality_rules.passes_policy("v2").alias("kept"),
    )


# --- 9: quality classifier ------------------------------------------------------

#: Score from which a document counts as good.
GOOD = 0.3


@register("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"), "passages", "top_passage", "top_weight",
    )


# --- 10: language-model scores --------------------------------------------------


@register("op10_lm_scores")
def op10_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return suffix_tree.score(docs, suffix_tree.outside_fold(10, 0))


# --- 11: collocations -----------------------------------------------------------

PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
f AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS a
    FROM (SELECT lang, m, w, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m)
    GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
split AS (SELECT lang, m, phrase, a, k, string_split(phrase, ' ') AS w FROM f, (VALUES (1), (2), (3)) v(k) WHERE m > k),
cut AS (SELECT s.lang, s.m, s.phrase, s.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * s.a) // (x.a::HUGEINT + y.a) AS score
    FROM split s JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(w[1 : k], ' ')
    JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(w[k + 1 : s.m], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS more FROM (
    SELECT lang, m, a, string_split(phrase, ' ') AS w, j, unnest(generate_series(1, m - j + 1)) AS i FROM f, (VALUES (2), (3)) v(j) WHERE m > j) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON b.lang = i.lang AND b.phrase = i.phrase WHERE more IS NULL OR 100 * more < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


@register("op11_collocations", PHRASES_SQL)
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


# --- 12: conversation repair ----------------------------------------------------

# A step takes one more turn of every conversation: Delete, Keep or Rerole, then up to two Inserts.
# States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(k, ''), lambda c: [CAST(unicode(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)),
    CAST(4294967295 AS BIGINT)) % 20 AS fate FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 0 THEN CAST([] AS INTEGER[]) WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, md5(text) ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
turns AS (SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) AS n
    FROM turns GROUP BY conv_id),
crossed AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, i, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS p FROM turns)
    WHERE i > 1 AND p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
known AS (SELECT DISTINCT conv_id FROM conversations),
inserts(a, b, n, audit, text) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 1, 'I', ['user:']), (1, 2, 1, 'I', ['user:']), (3, 2, 1, 'I', ['user:']), (2, 3, 1, 'I', ['assistant:']),
    (0, 3, 2, 'II', ['user:', 'assistant:']), (1, 3, 2, 'II', ['user:', 'assistant:'])),
ways AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, b AS state, {'cost': CAST(3 * n AS BIGINT), 'audit': audit, 'text': text} AS way FROM known, inserts WHERE a = 0
    UNION ALL
    SELECT conv_id, i, b, min({'cost': m.cost + 3 * n, 'audit': m.audit || x.audit, 'text': list_concat(m.text, x.text)}) FROM (
        SELECT w.conv_id, t.i, unnest([{'s': w.state, 'cost': w.way.cost + 4, 'audit': w.way.audit || 'D', 'text': w.way.text}]
            || CASE WHEN t.fault IN (1, 2) THEN [] ELSE
                CASE WHEN (t.r = 's' AND w.state = 0) OR (t.r = 'u' AND w.state <> 2) OR (t.r = 'a' AND w.state = 2) THEN
                    [{'s': CASE t.r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': w.way.cost + CASE WHEN t.fault = 3 THEN 3 ELSE 0 END,
                    'audit': w.way.audit || 'K', 'text': list_append(w.way.text, t.role || ':' || t.text)}] ELSE [] END
                || [{'s': CASE WHEN w.state = 2 THEN 3 ELSE 2 END, 'cost': w.way.cost + CASE WHEN t.fault = 3 THEN 6 ELSE 3 END,
                    'audit': w.way.audit || 'R', 'text': list_append(w.way.text, CASE WHEN w.state = 2 THEN 'assistant' ELSE 'user' END || ':' || t.text)}] END) AS m
        FROM ways w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1) JOIN inserts x ON m.s = x.a
    GROUP BY conv_id, i, b),
ended AS (SELECT w.conv_id, min(w.way) AS way FROM ways w LEFT JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
    WHERE w.i = coalesce(c.n, 0) AND w.state IN (0, 3) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, e.way.cost AS cost, e.way.audit AS audit, sha256(array_to_string(e.way.text, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN crossed x ON e.conv_id IS NOT DISTINCT FROM x.conv_id
"""


@register("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


# --- 13: html extraction --------------------------------------------------------


@register("op13_html_extract")
def op13_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages.select("page_id", "url", "html"), html_extract.learn(pages))
