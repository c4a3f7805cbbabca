"""Queries over detection, the vault, restoration and evaluation, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cipher, regions
from ..operators import chunks, detectors, evaluate, known, merge, pseudonymize, vault
from ..operators.catalogue import Catalogue
from . import synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Only types whose values the letters hold; a letter is one text of the mapping of its customer's nation.
RULES = Catalogue().overlaid({"PHONE": {"validator": None}})
_LETTERS = f"SELECT c_custkey AS seq, CAST(c_nationkey AS VARCHAR(9)) AS mapping, {synth.LETTER} AS text FROM customer"
_KINDS = [(k, v) for _, k, v in synth.PARTS]
#: Key of each value, as SQL.
_NORM = {"IBAN": synth.IBAN, "CARD": synth.CARD, "EMAIL": synth.EMAIL, "PHONE": f"'+49170' || {synth.LINE}", "IP": synth.IP, "TAX_ID": synth.VAT}
_MENTIONS = " UNION ALL ".join(
    f"SELECT c_custkey AS seq, CAST(c_nationkey AS VARCHAR(9)) AS mapping, {synth.part_start(i)} AS start, '{k}' AS type, {v} AS surface, {_NORM[k]} AS norm FROM customer" for i, (k, v) in enumerate(_KINDS)
)
_ENTITIES = f"""
  SELECT type, norm, suffix_index, '[[' || type || '_' || CASE WHEN b < 26 THEN chr((65 + b)::INT) WHEN b < 702 THEN chr((64 + b // 26)::INT) || chr((65 + b % 26)::INT)
      ELSE chr((64 + (b - 26) // 676)::INT) || chr((65 + ((b - 26) // 26) % 26)::INT) || chr((65 + b % 26)::INT) END || (suffix_index % 9 + 1) || ']]' AS placeholder
  FROM (SELECT *, suffix_index // 9 AS b FROM (
    SELECT type, norm, row_number() OVER (ORDER BY seq, start, type, norm) - 1 AS suffix_index FROM (
      SELECT type, norm, min(struct_pack(seq := seq, start := start)).seq AS seq, min(struct_pack(seq := seq, start := start)).start AS start FROM mentions GROUP BY 1, 2) q) r) s
"""
_VAULT = f"WITH mentions AS ({_MENTIONS}), entities AS ({_ENTITIES}), entries AS (SELECT mapping, placeholder, m.type, arg_min(surface, struct_pack(seq := seq, start := start)) AS original, count(*) AS occurrences FROM mentions m JOIN entities e ON m.type = e.type AND m.norm = e.norm WHERE m.type <> 'CARD' GROUP BY 1, 2, 3)"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.run_sql(spark, sf_dir, _MENTIONS)


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    mentions = _mentions(spark, sf_dir)
    entities = vault.new_entities(mentions)
    return mentions, entities, vault.restore_entries(mentions, entities, ["CARD"])


@query("entity_resolution", f"{_VAULT} SELECT type, norm, suffix_index::BIGINT AS suffix_index, placeholder FROM entities")
def entity_resolution(spark, sf_dir):
    return vault.new_entities(_mentions(spark, sf_dir))


@query("restore_table", f"{_VAULT} SELECT mapping, placeholder, type, original, occurrences FROM entries")
def restore_table(spark, sf_dir):
    return _entries(spark, sf_dir)[2]


@query("irreversible_digest", f"{_VAULT} SELECT DISTINCT type, CASE WHEN type = 'CARD' THEN sha256(norm) ELSE norm END AS stored FROM mentions")
def irreversible_digest(spark, sf_dir):
    return vault.stored_values(_mentions(spark, sf_dir), ["CARD"])


@query("vault_stats", f"{_VAULT} SELECT type, count(*) AS n FROM entities GROUP BY 1")
def vault_stats(spark, sf_dir):
    return vault.stats(vault.new_entities(_mentions(spark, sf_dir)))


@query("irreversible_placeholders", f"{_VAULT} SELECT placeholder FROM entities e WHERE NOT EXISTS (SELECT 1 FROM entries x WHERE x.placeholder = e.placeholder)")
def irreversible_placeholders(spark, sf_dir):
    _, entities, entries = _entries(spark, sf_dir)
    return vault.irreversible_placeholders(entities, entries)


_MAPPINGS = "SELECT CAST(n_nationkey AS VARCHAR(9)) AS mapping, n_name AS source_name, n_nationkey * 7 % 25 AS created_at FROM nation"
_ASKED = "SELECT mapping, placeholder FROM (SELECT CAST((CAST(mapping AS INT) + CAST(length(original) AS INT) % 2) % 25 AS VARCHAR(9)) AS mapping, placeholder FROM entries UNION ALL SELECT '0', placeholder FROM entities WHERE type = 'CARD' UNION ALL SELECT '1', '[[PERSON_ZZZZ9]]') q"


@query("recent_mappings", f"SELECT mapping, source_name, created_at FROM ({_MAPPINGS}) q WHERE source_name ILIKE '%ation_1%' ORDER BY created_at DESC, mapping DESC LIMIT 5")
def recent_mappings(spark, sf_dir):
    return vault.recent_mappings(synth.run_sql(spark, sf_dir, _MAPPINGS), 5, "ation_1")


@query(
    "covering_mappings",
    f"{_VAULT}, maps AS ({_MAPPINGS}), wanted AS (SELECT min(placeholder) AS placeholder FROM entries WHERE mapping = '3' UNION SELECT max(placeholder) FROM entries WHERE mapping = '3')"
    " SELECT e.mapping, created_at FROM entries e JOIN (SELECT * FROM maps ORDER BY created_at DESC LIMIT 50) m ON e.mapping = m.mapping WHERE placeholder IN (SELECT placeholder FROM wanted)"
    " GROUP BY 1, 2 HAVING count(DISTINCT placeholder) = (SELECT count(DISTINCT placeholder) FROM wanted)",
)
def covering_mappings(spark, sf_dir):
    entries = _entries(spark, sf_dir)[2]
    own = entries.where(F.col("mapping") == "3")
    wanted = own.agg(F.min("placeholder").alias("placeholder")).union(own.agg(F.max("placeholder")))
    return vault.covering_mappings(entries, synth.run_sql(spark, sf_dir, _MAPPINGS), wanted)


@query(
    "placeholder_outcomes",
    f"{_VAULT}, asked AS ({_ASKED}) SELECT DISTINCT a.mapping, a.placeholder, CASE WHEN x.placeholder IS NOT NULL THEN 'restored' WHEN e.placeholder IS NULL THEN 'unknown'"
    " WHEN NOT EXISTS (SELECT 1 FROM entries y WHERE y.placeholder = a.placeholder) THEN 'irreversible' ELSE 'foreign' END AS outcome"
    " FROM asked a LEFT JOIN entries x ON x.mapping = a.mapping AND x.placeholder = a.placeholder LEFT JOIN entities e ON e.placeholder = a.placeholder",
)
def placeholder_outcomes(spark, sf_dir):
    _, entities, entries = _entries(spark, sf_dir)
    moved = F.pmod(F.col("mapping").cast("int") + F.char_length("original") % 2, F.lit(25)).cast("string")
    asked = entries.select(moved.alias("mapping"), "placeholder").union(entities.where("type = 'CARD'").select(F.lit("0"), "placeholder")).union(spark.range(1).select(F.lit("1"), F.lit("[[PERSON_ZZZZ9]]")))
    return vault.outcomes(asked, entries, entities)


@query(
    "adopt_placeholders",
    f"{_VAULT}, asked AS ({_ASKED}) SELECT DISTINCT a.mapping, a.placeholder, e.type, o.original FROM asked a JOIN entities e ON e.placeholder = a.placeholder"
    " JOIN (SELECT placeholder, arg_min(original, mapping) AS original FROM entries GROUP BY 1) o ON o.placeholder = a.placeholder"
    " WHERE NOT EXISTS (SELECT 1 FROM entries x WHERE x.mapping = a.mapping AND x.placeholder = a.placeholder)",
)
def adopt_placeholders(spark, sf_dir):
    _, entities, entries = _entries(spark, sf_dir)
    moved = F.pmod(F.col("mapping").cast("int") + F.char_length("original") % 2, F.lit(25)).cast("string")
    asked = entries.select(moved.alias("mapping"), "placeholder").union(spark.range(1).select(F.lit("1"), F.lit("[[PERSON_ZZZZ9]]")))
    return vault.adopted(asked, entities, entries)


def _pseudonymised(spark, sf_dir) -> pseudonymize.Result:
    return pseudonymize.pseudonymize(synth.run_sql(spark, sf_dir, _LETTERS, deal=True), RULES)


_PLACED = " || ".join(f"'{lead}' || max(placeholder) FILTER (m.type = '{k}')" for lead, k, _ in synth.PARTS) + " || '.'"


@query("pseudonymize_letters", f"{_VAULT} SELECT mapping, seq, {_PLACED} AS pseudonymised, 6 AS n_replaced FROM mentions m JOIN entities e ON m.type = e.type AND m.norm = e.norm GROUP BY 1, 2")
def pseudonymize_letters(spark, sf_dir):
    return _pseudonymised(spark, sf_dir).texts


_BACK = " || ".join(f"'{lead}' || " + (f"max(placeholder) FILTER (m.type = '{k}')" if k == "CARD" else f"max(surface) FILTER (m.type = '{k}')") for lead, k, _ in synth.PARTS) + " || '.'"


@query("reverse_roundtrip", f"{_VAULT} SELECT mapping, seq, {_BACK} AS restored FROM mentions m JOIN entities e ON m.type = e.type AND m.norm = e.norm GROUP BY 1, 2")
def reverse_roundtrip(spark, sf_dir):
    result = _pseudonymised(spark, sf_dir)
    return pseudonymize.reverse(result.texts, result.entries).select("mapping", "seq", "restored")


#: Bent placeholders among words and what comes back; blanks between a comma or bracket and a placeholder belong to its match.
_BENT = {
    "Bitte rufen Sie Person A1 an, dann {n}.": "Bitte rufen Sie {n} an, dann {n}.", "Ich sah PERSON_A1 und [PERSON_A2] heute": "Ich sah {n} und A {n} heute",
    "hallo person a1! Die [['National ID A3']] gilt": "hallo {n}! Die N{k} gilt", "Zu [ [PERSON_A1 ]], PersonA2 und ID A4 gehört PERSON_B7": "Zu [ {n},A {n} und I{k} gehört PERSON_B7",
    "Siehe national id a4 oder Personen A1": "Siehe national I{k} oder Personen A1",
}
_AS_SQL = lambda text: "'" + text.replace("'", "''").replace("{n}", "' || c_name || '").replace("{k}", "' || c_custkey || '") + "'"


@query("reverse_fuzzy", "SELECT c_custkey AS seq, CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN {_AS_SQL(v)}" for i, v in enumerate(_BENT.values())) + " END AS restored FROM customer")
def reverse_fuzzy(spark, sf_dir):
    texts = [k.replace("'", "\\'").replace("{n}", "' || c_name || '") for k in _BENT]
    made = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"
    names = synth.run_sql(spark, sf_dir, f"SELECT c_custkey AS seq, CAST(c_custkey AS VARCHAR(20)) AS mapping, c_name, {made} AS pseudonymised FROM customer", deal=True)
    known = {"[[PERSON_A1]]": F.col("c_name"), "[[PERSON_A2]]": F.concat(F.lit("A "), F.col("c_name")), "[[NATIONAL_ID_A3]]": F.concat(F.lit("N"), "seq"), "[[ID_A4]]": F.concat(F.lit("I"), "seq")}
    entries = names.select("mapping", F.explode(F.array(*[F.struct(F.lit(k).alias("placeholder"), v.alias("original")) for k, v in known.items()])).alias("e")).select("mapping", "e.*")
    return pseudonymize.reverse(names.select("mapping", "seq", "pseudonymised"), entries, fuzzy=True).select("seq", "restored")


@query("reverse_adopted", f"SELECT c_custkey AS seq, 'Wie ' || {synth.EMAIL} || ' schrieb: an [[CARD_ZZ9]], von neu' || c_custkey || '@test.de.' AS restored FROM customer")
def reverse_adopted(spark, sf_dir):
    """A later batch whose texts hold placeholders of an earlier one, in mappings of their own."""
    mentions, entities, entries = _entries(spark, sf_dir)
    mails = mentions.where("type = 'EMAIL'").join(vault.shuffled(entities), ["type", "norm"]).select("seq", "placeholder")
    text = F.concat(F.lit("Wie "), "placeholder", F.lit(" schrieb: an [[CARD_ZZ9]], von neu"), "seq", F.lit("@test.de."))
    docs = mails.select(F.concat(F.lit("again-"), "seq").alias("mapping"), "seq", text.alias("text"))
    docs = synth.dealt(docs)
    done = pseudonymize.pseudonymize(docs, RULES, entities=entities, adopt=True, issued=entries)
    return pseudonymize.reverse(done.texts, done.entries).select("seq", "restored")


@query("pseudonymize_documents")
def pseudonymize_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("mapping"), F.col("doc_id").alias("seq"), "text")
    return pseudonymize.pseudonymize(docs, RULES).texts


@query("batch_digest", "SELECT conv_id, sha256(string_agg(text, chr(31) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def batch_digest(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.sha2(F.array_join(F.col("t.text"), "\u001f").cast("binary"), 256).alias("digest"))


@query(
    "mask_html_comments",
    "SELECT page_id, length(html) AS n, length(html) - length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS hidden, length(regexp_extract_all(html, '(?s)<!--.*?-->')::VARCHAR) > 2 AS has FROM pages",
)
def mask_html_comments(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("r", regions._as(regions.spans(F.col("html"), regions.COMMENT), "html-comment"))
    pages = pages.withColumn("view", regions.masked(F.col("html"), F.col("r")))
    hidden = F.aggregate("r", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return pages.select("page_id", F.char_length("view").cast("bigint").alias("n"), hidden.cast("bigint").alias("hidden"), (F.size("r") > 0).alias("has"))


_MARKDOWN = "SELECT c_custkey AS id, 'Text\n```\ncode ' || c_name || '\n```\nmehr `x` und https://a.de/' || CAST(c_custkey AS VARCHAR(20)) || ' <mailto:a@b.de> [t](http://c.de) Ende' AS text FROM customer"


@query("mask_markdown", "SELECT c_custkey AS id, 'Text\n' || '   ' || '\n' || repeat(' ', length(c_name) + 5) || '\n' || '   ' || '\nmehr     und ' || repeat(' ', 13 + length(c_custkey::VARCHAR)) || ' <mailto:a@b.de> [t](' || repeat(' ', 11) || ') Ende' AS view FROM customer")
def mask_markdown(spark, sf_dir):
    texts = synth.run_sql(spark, sf_dir, _MARKDOWN, deal=True)
    texts = texts.withColumn("r", regions.protected_regions(F.col("text")))
    return texts.select("id", regions.masked(F.col("text"), F.col("r")).alias("view"))


@query(
    "region_coalesce",
    """WITH r AS (SELECT l_orderkey AS id, (l_linenumber * 10 + l_partkey % 7)::INT AS s, (l_linenumber * 10 + l_partkey % 7 + 6)::INT AS e FROM lineitem),
       o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
       g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS run FROM o)
       SELECT id, min(s) AS start, max(e) AS "end" FROM g GROUP BY id, run""",
)
def region_coalesce(spark, sf_dir):
    start = (F.col("l_linenumber") * 10 + F.col("l_partkey") % 7).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(start.alias("start"), (start + 6).cast("int").alias("end"), F.lit("url").alias("kind"))).alias("r"))
    return rows.select("id", F.inline(regions.coalesced(F.col("r")))).select("id", "start", "end")


_CANDIDATES = "SELECT l_orderkey AS doc_id, (l_linenumber * 10 + l_partkey % 7) AS s, (l_linenumber * 10 + l_partkey % 7 + 5 + l_suppkey % 9) AS e, (l_quantity * 2) / 100 AS score, l_linenumber AS n FROM lineitem"


def _candidates(spark, sf_dir):
    one = merge.span(F.col("s"), F.col("e"), F.lit("x"), F.lit("PERSON"), F.col("score"), F.lit("model"), F.lit(None))
    return synth.run_sql(spark, sf_dir, _CANDIDATES).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("c"))


@query("merge_threshold", f"SELECT doc_id, count(*) AS n FROM ({_CANDIDATES}) q WHERE score >= 0.5 GROUP BY 1")
def merge_threshold(spark, sf_dir):
    kept = _candidates(spark, sf_dir).select("doc_id", F.size(merge.above(F.col("c"), {"PERSON": 0.5}, 0.9)).cast("bigint").alias("n"))
    return kept.where("n > 0")


@query(
    "merge_greedy_overlap",
    f"""WITH RECURSIVE c AS (SELECT doc_id, s::INT AS s, e::INT AS e, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, score DESC, s, e) AS k FROM ({_CANDIDATES}) q),
       f AS (SELECT doc_id, 0::BIGINT AS k, []::STRUCT(s INT, e INT)[] AS acc FROM c GROUP BY 1
             UNION ALL SELECT f.doc_id, c.k, CASE WHEN len(list_filter(acc, lambda o: o.s < c.e AND c.s < o.e)) > 0 THEN acc ELSE list_append(acc, struct_pack(s := c.s, e := c.e)) END
             FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1),
       l AS (SELECT doc_id, arg_max(acc, k) AS acc FROM f GROUP BY 1)
       SELECT doc_id, x.s AS start, x.e AS "end" FROM (SELECT doc_id, unnest(acc) AS x FROM l) q""",
)
def merge_greedy_overlap(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", F.inline(merge.greedy(F.col("c")))).select("doc_id", "start", "end")


@query("edge_trim", "SELECT c_custkey AS doc_id, 2 AS start, (2 + length(c_name))::INT AS \"end\", c_name AS text FROM customer")
def edge_trim(spark, sf_dir):
    docs = synth.run_sql(spark, sf_dir, "SELECT c_custkey AS doc_id, '(\"' || c_name || '\"), ' AS doc FROM customer")
    one = merge.span(F.lit(0), F.char_length("doc"), F.col("doc"), F.lit("PERSON"), F.lit(0.9), F.lit("model"), F.lit(None))
    return docs.select("doc_id", F.inline(merge.trimmed(F.array(one), F.col("doc")))).select("doc_id", "start", "end", "text")


@query("merge_exact_trim", f"SELECT c_custkey AS doc_id, 0 AS start, (9 + length(c_name))::INT AS \"end\", 'Kunde ' || c_name || ' an' AS text FROM customer")
def merge_exact_trim(spark, sf_dir):
    docs = synth.run_sql(spark, sf_dir, f"SELECT c_custkey AS doc_id, 'Kunde ' || c_name || ' an' || {synth.EMAIL} || '!!' AS doc, {synth.EMAIL} AS mail, c_name FROM customer", deal=True)
    begin = F.char_length("c_name") + 9
    model = merge.span(F.lit(0), F.char_length("doc"), F.col("doc"), F.lit("PERSON"), F.lit(0.9), F.lit("model"), F.lit(None))
    rule = merge.span(begin, begin + F.char_length("mail"), F.col("mail"), F.lit("EMAIL"), F.lit(1.0), F.lit("regex"), F.lit(None))
    return docs.select("doc_id", F.inline(merge.cut_to_exact(F.array(model, rule), F.col("doc")))).where("source = 'model'").select("doc_id", "start", "end", "text")


@query("validator_veto", f"SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 2 = 0 OR {synth._MOD} = 97")
def validator_veto(spark, sf_dir):
    docs = synth.run_sql(spark, sf_dir, f"SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN {synth.IBAN} ELSE 'DE00' || substr({synth.IBAN}, 5) END AS doc FROM customer", deal=True)
    one = merge.span(F.lit(0), F.char_length("doc"), F.col("doc"), F.lit("IBAN"), F.lit(0.9), F.lit("model"), F.lit(None))
    return docs.select("doc_id", F.inline(merge.unvetoed(F.array(one), {"IBAN": "iban_mod97"}))).select("doc_id")


@query("coref_sweep", "SELECT c_custkey AS doc_id, 3::BIGINT AS n FROM customer")
def coref_sweep(spark, sf_dir):
    docs = synth.run_sql(spark, sf_dir, "SELECT c_custkey AS doc_id, c_name || ' rief an. ' || c_name || '! Nicht X' || c_name || 'Y, aber ' || c_name || '.' AS text, c_name FROM customer", deal=True)
    docs = docs.withColumn("view", F.col("text")).withColumn("candidates", F.array(merge.span(F.lit(0), F.char_length("c_name"), F.col("c_name"), F.lit("PERSON"), F.lit(0.9), F.lit("model"), F.lit(None))))
    return merge.swept(docs, {"PERSON": "word"}).select("doc_id", F.size("candidates").cast("bigint").alias("n"))


_GOLD = "SELECT l_orderkey AS doc_id, 'T' || CAST(l_linenumber % 3 AS VARCHAR(2)) AS type, l_linenumber * 20 AS start, l_linenumber * 20 + 8 AS fin FROM lineitem"
_FOUND = "SELECT l_orderkey AS doc_id, 'T' || CAST(l_linenumber % 3 AS VARCHAR(2)) AS type, l_linenumber * 20 + CAST(l_partkey % 3 AS INT) * 6 AS start, l_linenumber * 20 + CAST(l_partkey % 3 AS INT) * 6 + 8 AS fin, l_quantity / 50 AS score FROM lineitem"


def _gold(spark, sf_dir):
    return synth.run_sql(spark, sf_dir, _GOLD).withColumnRenamed("fin", "end"), synth.run_sql(spark, sf_dir, _FOUND).withColumnRenamed("fin", "end")


# Gold spans lie 20 apart and predictions shift by 0, 6 or 12, so two overlap in the first two cases and no gold span has two.
_COUNTS = "SELECT 'T' || (l_linenumber % 3) AS type, count(*) FILTER (l_partkey % 3 < 2) AS tp, count(*) FILTER (l_partkey % 3 = 2) AS fp, count(*) FILTER (l_partkey % 3 = 2) AS fn FROM lineitem GROUP BY 1"


@query("eval_counts_partial", _COUNTS)
def eval_counts_partial(spark, sf_dir):
    return evaluate.counts(*_gold(spark, sf_dir))


@query("eval_counts_exact", _COUNTS.replace("< 2", "= 0").replace("% 3 = 2", "% 3 > 0"))
def eval_counts_exact(spark, sf_dir):
    return evaluate.counts(*_gold(spark, sf_dir), exact=True)


@query("eval_prf", f"SELECT type, tp, fp, fn, tp + fn AS support, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM ({_COUNTS}) q")
def eval_prf(spark, sf_dir):
    return evaluate.scores(evaluate.counts(*_gold(spark, sf_dir)))


@query(
    "eval_report",
    f"""WITH s AS (SELECT type, tp, fp, fn, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f FROM ({_COUNTS}) q)
    SELECT 0 AS at, '| type | tp | fp | fn | precision | recall | f1 |' AS line UNION ALL SELECT 1, '|---|---|---|---|---|---|---|'
    UNION ALL SELECT (row_number() OVER (ORDER BY fp DESC, type) + 1)::INT, printf('| %s | %d | %d | %d | %.3f | %.3f | %.3f |', type, tp::BIGINT, fp::BIGINT, fn::BIGINT, p, r, f) FROM s""",
)
def eval_report(spark, sf_dir):
    return evaluate.report(evaluate.scores(evaluate.counts(*_gold(spark, sf_dir))))


def _labelled(spark, sf_dir):
    gold_, found = _gold(spark, sf_dir)
    return gold_, found.withColumn("label", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("l"), F.col("doc_id") % 4)))


@query(
    "eval_by_label",
    "SELECT CASE WHEN l_orderkey % 4 = 0 THEN '(rule)' ELSE 'l' || (l_orderkey % 4) END AS label, count(*) FILTER (l_partkey % 3 < 2) AS tp, count(*) FILTER (l_partkey % 3 = 2) AS fp,"
    " count(*) FILTER (l_partkey % 3 < 2) / count(*) AS precision FROM lineitem GROUP BY 1",
)
def eval_by_label(spark, sf_dir):
    return evaluate.label_counts(*_labelled(spark, sf_dir))


_MISTAKES = "SELECT k AS kind, l_orderkey AS doc_id, 'T' || (l_linenumber % 3) AS type, (l_linenumber * 20 + CASE k WHEN 'fp' THEN 12 ELSE 0 END)::INT AS start FROM lineitem, (SELECT unnest(['fp', 'fn']) AS k) s WHERE l_partkey % 3 = 2"


@query("eval_mistakes", f'SELECT *, start + 8 AS "end" FROM ({_MISTAKES}) q')
def eval_mistakes(spark, sf_dir):
    return evaluate.mistakes(*_gold(spark, sf_dir))


@query(
    "eval_first_mistakes",
    f'SELECT kind, doc_id, type, start, start + 8 AS "end", n::INT AS n, greatest(0, c - 15) AS more FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, start, type) AS n, count(*) OVER (PARTITION BY kind) AS c FROM ({_MISTAKES}) q) r WHERE n <= 15',
)
def eval_first_mistakes(spark, sf_dir):
    return evaluate.first_mistakes(evaluate.mistakes(*_gold(spark, sf_dir)))


@query("eval_verdicts", f"SELECT type, type = 'T0' AS ok, CASE type WHEN 'T0' THEN 'meets bar' ELSE printf('recall %.3f under %.3f', tp / (tp + fn), 0.99) END AS reason FROM ({_COUNTS}) q WHERE type < 'T2' UNION ALL SELECT 'T9', true, 'nothing measured'")
def eval_verdicts(spark, sf_dir):
    bars = spark.createDataFrame([("T0", 0.1, 0.1), ("T1", 0.99, None), ("T2", None, None), ("T9", 0.9, 0.9)], "type string, min_recall double, min_precision double")
    return evaluate.verdicts(evaluate.scores(evaluate.counts(*_gold(spark, sf_dir))), bars)


@query("chunk_documents", "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS covered, true AS whole, true AS small FROM documents")
def chunk_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cuts = chunks.chunk_documents(docs.withColumn("original", F.col("text")), 512)
    size = F.char_length("text")
    cuts = cuts.withColumn("ok", F.substring(F.coalesce("original", F.lit("")), F.col("start") + 1, size) == F.col("text"))
    cuts = cuts.withColumn("small", (size <= 512) & ((size > 0) | (F.col("start") == 0)))
    return cuts.groupBy("doc_id").agg(F.max(F.col("start") + size).cast("bigint").alias("covered"), F.bool_and("ok").alias("whole"), F.bool_and("small").alias("small"))


@query(
    "placed_spans",
    "SELECT c_custkey AS doc_id, length('Sehr geehrte ') AS start, length('Sehr geehrte ') + length(c_name) AS \"end\", c_name AS text, 'PERSON' AS type, 'name' AS label, 0.5::DOUBLE AS score FROM customer",
)
def placed_spans(spark, sf_dir):
    docs = synth.run_sql(spark, sf_dir, "SELECT c_custkey AS doc_id, 'Sehr geehrte ' || c_name || ', guten Tag' AS text, c_name AS surface FROM customer")
    shared = F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk")
    found = docs.select("doc_id", shared, "surface").select("doc_id", "chunk", (F.col("chunk") * 9).alias("start"), F.lit("PERSON").alias("type"), F.lit("name").alias("label"), "surface", (F.col("doc_id") % 20).cast("int").alias("at"), F.lit(0.5).alias("score"))
    return chunks.placed_spans(found, docs.select("doc_id", "text"))


@query(
    "threshold_sweep",
    "SELECT 'T' || (l_linenumber % 3) AS type, t AS threshold, count(*) FILTER (ok AND l_partkey % 3 < 2) AS tp, count(*) FILTER (ok AND l_partkey % 3 = 2) AS fp, count(*) FILTER (NOT (ok AND l_partkey % 3 < 2)) AS fn"
    " FROM (SELECT *, l_quantity / 50 >= t AS ok FROM lineitem, (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS t) s) q GROUP BY 1, 2",
)
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(*_gold(spark, sf_dir), [0.3, 0.5, 0.7, 0.9])


_LABELS = ["email", "EMAIL", "phone number", "no such label", "iban", "person"]


def _routed() -> str:
    known = Catalogue().labels()
    return " ".join(f"WHEN {i} THEN {repr(known[x]) if x in known else 'NULL'}" for i, x in enumerate(_LABELS))


@query("catalogue_labels", f"SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE (l_orderkey + l_linenumber) % {len(_LABELS)} {_routed()} END AS type FROM lineitem")
def catalogue_labels(spark, sf_dir):
    """Spans of a model, one a row, and the types that the catalogue gives their labels; null for unknown ones."""
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_LABELS) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), label.alias("label"))
    return Catalogue().routed(rows).select("doc_id", "n", "type")


@query("encrypted_values", f"{_VAULT} SELECT DISTINCT placeholder, original, length(original) > 0 AS hidden, true AS bound FROM entries")
def encrypted_values(spark, sf_dir):
    """Entries whose values are stored encrypted, found again by keyed digests of their entities and opened."""
    mentions, entities, entries = _entries(spark, sf_dir)
    secret = "of a test"
    kept = entities.select(cipher.lookup(F.col("type"), F.col("norm"), secret).alias("entity"), "placeholder")
    values = entries.select("placeholder", F.col("original").alias("plain"), cipher.encrypted(F.col("original"), secret, F.col("placeholder")).alias("stored")).dropDuplicates(["placeholder", "plain"])
    asked = mentions.where("type <> 'CARD'").select(cipher.lookup(F.col("type"), F.col("norm"), secret).alias("entity")).distinct()
    found = asked.join(vault.shuffled(kept), "entity").join(vault.shuffled(values), "placeholder")
    opened, other = (cipher.decrypted(F.col("stored"), secret, x) for x in (F.col("placeholder"), F.lit("[[OTHER_A1]]")))
    return found.select("placeholder", opened.alias("original"), (F.instr("stored", F.col("plain")) == 0).alias("hidden"), other.isNull().alias("bound"))


@query("detection_cache_hits", "SELECT source, count(*) AS requests, count(DISTINCT text) AS scanned FROM documents GROUP BY 1")
def detection_cache_hits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.count("*").alias("n"))
    return docs.groupBy("source").agg(F.sum("n").alias("requests"), F.count("*").alias("scanned"))


#: One text per order, which repeats what its customer's other orders say; a first run sees those that are finished.
_ASKED = "SELECT o_orderkey, o_orderpriority, o_orderstatus, o_custkey, 'Zu Kunde kunde' || CAST(o_custkey AS VARCHAR(20)) || '@bank.de' AS text FROM orders"
_MET = f"SELECT *, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS known FROM ({_ASKED}) q"


def _second_run(spark, sf_dir):
    asked = synth.run_sql(spark, sf_dir, _ASKED)
    first = known.looked_up(asked.where("o_orderstatus = 'F'"), RULES, None, 1)
    return first, known.looked_up(asked, RULES, first.log, 2)


@query("known_texts", f"SELECT o_orderkey, known, 9 AS start, length(text)::INT AS \"end\", 'EMAIL' AS type, substr(text, 10) AS surface FROM ({_MET}) m")
def known_texts(spark, sf_dir):
    """Orders' texts in a second run: whether the first one scanned them, and what is found in them either way."""
    found = known.resolved(_second_run(spark, sf_dir)[1].docs, RULES)
    return found.select("o_orderkey", "known", F.inline("candidates")).select("o_orderkey", "known", "start", "end", "type", F.col("text").alias("surface"))


@query(
    "detection_hit_rates",
    f"SELECT o_orderpriority, count(*) AS requests, count(DISTINCT o_custkey) AS asked, count(DISTINCT o_custkey) FILTER (known) AS hits, count(DISTINCT o_custkey) FILTER (known) / count(DISTINCT o_custkey) AS hit_rate FROM ({_MET}) m GROUP BY 1",
)
def detection_hit_rates(spark, sf_dir):
    return known.hit_rates(_second_run(spark, sf_dir)[1].docs, ["o_orderpriority"])


@query(
    "recently_used_texts",
    f"SELECT text_key, used FROM (SELECT *, row_number() OVER (ORDER BY used DESC, text_key) AS n FROM (SELECT sha256(text) AS text_key, 2::BIGINT AS used FROM ({_MET}) m GROUP BY 1) q) r WHERE n <= 2048",
)
def recently_used_texts(spark, sf_dir):
    """The log of two runs, cut down to the 2,048 texts used last."""
    first, second = _second_run(spark, sf_dir)
    return known.recent(first.log.unionByName(second.log), 2048).select("text_key", "used")


_W = r"[\p{L}\p{N}_]"
_NAME = "[A-Za-z]+ [a-z]+"


@query(
    "listed_names_in_documents",
    f"""
    WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}+') AS w, string_split_regex(text, '{_W}+') AS g FROM documents),
    u AS (SELECT doc_id, text, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, unnest(range(len(w))) AS i FROM m),
    p AS (SELECT doc_id, text, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS start FROM u),
    n AS (SELECT DISTINCT lower(regexp_extract(text, '{_NAME}')) AS low FROM documents WHERE regexp_extract(text, '{_NAME}') <> ''),
    h AS (SELECT doc_id, start, length(low) AS size, substr(text, start::BIGINT + 1, length(low)) AS surface FROM p JOIN n ON lower(word) = regexp_extract(low, '^{_W}+')
          WHERE lower(substr(text, start::BIGINT + 1, length(low))) = low AND NOT regexp_matches(substr(text, (start + length(low))::BIGINT + 1, 1), '{_W}'))
    SELECT doc_id, start::INT AS start, (start + size)::INT AS "end", surface FROM (SELECT *, max(size) OVER (PARTITION BY doc_id, start) AS most FROM h) q WHERE size = most
    """,
)
def listed_names_in_documents(spark, sf_dir):
    """Each text's first two words together as a list of names, found in all texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = docs.select(F.regexp_extract("text", _NAME, 0).alias("name"), F.lit("PERSON").alias("type"))
    return detectors.listed_spans(docs, names).select("doc_id", "start", "end", F.col("text").alias("surface"))
