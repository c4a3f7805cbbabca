"""Queries over requests, answers and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import placeholder, requests
from ..operators import bodies, protocols
from ..sources import gold
from ..streaming import holdback, responses, sse
from . import synth

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query("request_text_nodes", "SELECT conv_id, 'messages/' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '/content' AS pointer, text FROM conversations WHERE text <> ''")
def request_text_nodes(spark, sf_dir):
    turns = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    return bodies.text_nodes(turns.select("conv_id", body.alias("body")), protocols.chat_request()).drop("was_number")


@query(
    "placeholder_hints",
    "SELECT conv_id, count(*) + CASE WHEN max(turn) > 2 THEN 1 ELSE 0 END AS n, CASE WHEN max(turn) > 2 THEN 'system' ELSE arg_min(role, turn) END AS first_role,"
    " arg_max(text, turn) AS last_text, max(turn) > 2 AS told FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY 1",
)
def placeholder_hints(spark, sf_dir):
    """Requests of conversations, where those of over three turns count as having placeholders."""
    turns = _turns(spark, sf_dir).where("text is not null and role is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"), F.max("turn").alias("last"))
    body = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    out = bodies.hinted(turns.select("conv_id", body.alias("body"), F.when(F.col("last") > 2, F.col("last")).alias("n_replaced")), "messages")
    out = out.withColumn("m", F.from_json(F.get_json_object("body", "$.messages"), "array<struct<role:string,content:string>>"))
    return out.select("conv_id", F.size("m").cast("bigint").alias("n"), F.get("m.role", F.lit(0)).alias("first_role"), F.element_at("m.content", -1).alias("last_text"), (F.get("m.content", F.lit(0)) == requests.HINT).alias("told"))


@query("request_refusals", "SELECT conv_id, turn, turn % 3 = 0 AS refused FROM conversations")
def request_refusals(spark, sf_dir):
    extra = F.when(F.col("turn") % 3 == 0, F.lit("x"))
    message = F.struct("role", F.col("text").alias("content"), extra.alias("audio"))
    asked = _turns(spark, sf_dir).select("conv_id", "turn", F.to_json(F.struct(F.array(message).alias("messages"))).alias("body"))
    return bodies.refusals(asked, protocols.chat_request()).drop("pointers")


@query(
    "answer_texts",
    "SELECT conv_id, turn, 'choices/0/message/content' AS pointer, text FROM conversations WHERE text IS NOT NULL"
    " UNION ALL SELECT conv_id, turn, 'choices/0/message/tool_calls/0/function/arguments/who/0', role FROM conversations WHERE role IS NOT NULL",
)
def answer_texts(spark, sf_dir):
    arguments = F.to_json(F.struct(F.array("role").alias("who"), F.lit(7).alias("n")))
    call = F.struct(F.lit("c").alias("id"), F.struct(F.lit("f").alias("name"), arguments.alias("arguments")).alias("function"))
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"), F.array(call).alias("tool_calls"))
    body = F.to_json(F.struct(F.lit("x").alias("id"), F.array(F.struct(F.lit(0).alias("index"), message.alias("message"))).alias("choices")))
    return bodies.text_nodes(_turns(spark, sf_dir).select("conv_id", "turn", body.alias("body")), protocols.chat_answer()).drop("was_number")


_PART = "CASE turn % 3 WHEN 0 THEN '/content' WHEN 1 THEN '/content/0/text' ELSE '/action/command/0' END"


@query(
    "responses_text_nodes",
    f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE text <> '')"
    f" SELECT conv_id, 'input/' || (2 * i) || {_PART} AS pointer, text, false AS was_number FROM t"
    " UNION ALL SELECT conv_id, 'input/' || (2 * i + 1) || '/arguments/who~1what/0', role, false FROM t UNION ALL SELECT conv_id, 'input/' || (2 * i + 1) || '/arguments/turn', turn::VARCHAR, true FROM t"
    " UNION ALL SELECT DISTINCT conv_id, 'instructions', 'Gespräch ' || conv_id, false FROM t",
)
def responses_text_nodes(spark, sf_dir):
    # A text as JSON: what to_json writes, without its key and braces.
    turns = _turns(spark, sf_dir).where("text <> ''").withColumn("s", F.expr("substring(to_json(struct(text AS t)), 6, length(to_json(struct(text AS t))) - 6)"))
    call = F.to_json(F.struct(F.lit("function_call").alias("type"), F.to_json(F.struct(F.array("role").alias("who/what"), F.col("turn").alias("turn"), F.lit(True).alias("ok"))).alias("arguments")))
    item = F.when(F.col("turn") % 3 == 0, F.format_string('{"role": "user", "content": %s}', "s")).when(F.col("turn") % 3 == 1, F.format_string('{"type": "message", "content": [{"type": "output_text", "text": %s, "annotations": []}]}', "s"))
    item = item.otherwise(F.format_string('{"type": "shell_call", "id": "c", "action": {"command": [%s], "timeout": 5}}', "s"))
    items = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(",", item, call).alias("item")))).alias("m"))
    body = F.format_string('{"model": "m", "tools": [{"name": "x"}], "instructions": "Gespräch %d", "input": [%s]}', "conv_id", F.array_join("m.item", ","))
    return bodies.text_nodes(items.select("conv_id", body.alias("body")), protocols.responses_request())


#: Items of requests, and for each whether it is refused.
_ITEMS = {
    '{"role": "user", "content": "a"}': False, '{"type": "input_image", "url": "u"}': True, '{"role": "user", "content": [{"type": "input_image", "url": "u"}]}': True,
    '{"type": "message", "content": "a", "odd": {"n": [1, 2]}}': False, '{"type": "message", "content": "a", "odd": {"n": ["x"]}}': True, '{"type": "function_call", "arguments": "{no"}': True,
    '{"type": "reasoning", "summary": ["x"]}': False, '"bare"': True, '{"type": "custom_tool_call", "input": null}': False,
}


@query("responses_refusals", f"SELECT o_orderkey AS id, {sorted(k for k, v in enumerate(_ITEMS.values()) if v)}.list_contains((o_orderkey % {len(_ITEMS)})::INT) AS refused FROM orders")
def responses_refusals(spark, sf_dir):
    item = F.element_at(F.array(*[F.lit(x) for x in _ITEMS]), (F.col("o_orderkey") % len(_ITEMS) + 1).cast("int"))
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"input": ['), item, F.lit("]}")).alias("body"))
    return bodies.refusals(asked, protocols.responses_request()).drop("pointers")


@query(
    "responses_answer_texts",
    "SELECT conv_id, turn, 'output/1/content/0/text' AS pointer, text FROM conversations WHERE text <> '' UNION ALL SELECT conv_id, turn, 'output/2/arguments/who/0', role FROM conversations WHERE role <> ''"
    " UNION ALL SELECT conv_id, turn, 'output/3/arguments', '{\"who\": ' || role FROM conversations WHERE role <> ''",
)
def responses_answer_texts(spark, sf_dir):
    part = F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"))
    call = lambda x: F.struct(F.lit("function_call").alias("type"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"), x.alias("arguments"))
    message = F.struct(F.lit("message").alias("type"), F.array(part).alias("content"), F.lit(None).cast("string").alias("arguments"))
    skipped = F.struct(F.lit("reasoning").alias("type"), F.array(part).alias("content"), F.lit(None).cast("string").alias("arguments"))
    output = F.array(skipped, message, call(F.to_json(F.struct(F.array("role").alias("who"), F.lit(7).alias("n")))), call(F.concat(F.lit('{"who": '), "role")))
    return bodies.text_nodes(_turns(spark, sf_dir).select("conv_id", "turn", F.to_json(F.struct(output.alias("output"))).alias("body")), protocols.responses_answer()).drop("was_number")


@query("argument_leaves", "SELECT c_custkey AS id, 'who/name' AS pointer, c_name AS text, false AS was_number FROM customer UNION ALL SELECT c_custkey, 'who/ids/0', c_custkey::VARCHAR, true FROM customer")
def argument_leaves(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.array("c_custkey").alias("ids"), F.lit(True).alias("ok")).alias("who"))).alias("arguments"))
    return bodies.argument_leaves(rows)


@query("write_back", "SELECT conv_id, turn, upper(role) AS content FROM conversations")
def write_back(spark, sf_dir):
    body = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    out = _turns(spark, sf_dir).select("conv_id", "turn", requests.written_back(body, F.array(F.lit("messages/0/content")), F.array(F.upper("role"))).alias("b"))
    return out.select("conv_id", "turn", F.get_json_object("b", "$.messages[0].content").alias("content"))


def _deltas(spark, sf_dir):
    text = F.concat(F.lit("Von [[PERSON_A1]] an "), F.col("c_name"), F.lit(" [[EMAIL_B2]]."))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("stream_id"), text.alias("t"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("t") - 1) / 5).cast("int")), lambda i: F.substring("t", i * 5 + 1, F.lit(5)))
    return rows.select("stream_id", F.lit(0).alias("choice"), F.posexplode(cuts).alias("seq", "delta"))


@query("holdback_reassembly", "SELECT c_custkey::VARCHAR AS stream_id, 0 AS choice, 'Von [[PERSON_A1]] an ' || c_name || ' [[EMAIL_B2]].' AS text FROM customer")
def holdback_reassembly(spark, sf_dir):
    return holdback.restore_batch(_deltas(spark, sf_dir))


@query("holdback_pieces", "SELECT c_custkey::VARCHAR AS stream_id, 'Von [[PERSON_A1]] an ' || c_name || ' [[EMAIL_B2]].' AS text, 2::BIGINT AS whole, false AS torn FROM customer")
def holdback_pieces(spark, sf_dir):
    pieces = holdback.released_batch(_deltas(spark, sf_dir))
    whole, torn = F.regexp_count("released", F.lit(placeholder.PLACEHOLDER)), F.col("released").rlike(holdback.TAIL)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "released"))), lambda x: x["released"]), "")
    return pieces.groupBy("stream_id").agg(text.alias("text"), F.sum(whole).alias("whole"), F.bool_or(torn).alias("torn"))


@query("toolcall_assembly", "SELECT conv_id::VARCHAR AS stream_id, 0 AS choice, 0 AS call, 'send' AS name, string_agg(text, '' ORDER BY turn) AS arguments FROM conversations GROUP BY 1")
def toolcall_assembly(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    rows = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("stream_id"), F.lit(0).alias("choice"), F.lit(0).alias("call"), F.col("turn").alias("seq"), F.when(first, "send").alias("name"), F.col("text").alias("arguments"))
    return holdback.assemble_calls(rows)


@query("sse_events", "SELECT c_custkey AS id, pos::INT AS pos, CASE pos WHEN 0 THEN 'delta' END AS event, CASE pos WHEN 0 THEN 'a' || chr(10) || c_name ELSE '[DONE]' END AS data FROM customer, range(2) t(pos)")
def sse_events(spark, sf_dir):
    raw = F.concat(F.lit("event: delta\r\ndata: a\r\ndata: "), F.col("c_name"), F.lit("\r\n\r\ndata: [DONE]\n\n"))
    return holdback.sse_events(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), raw.alias("raw")))


_CUT = "SELECT conv_id::VARCHAR AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN turn % 2 = 0 THEN role END AS event, coalesce(text, '') AS data FROM conversations"


@query("sse_from_bytes", _CUT)
def sse_from_bytes(spark, sf_dir):
    """Each conversation as a stream of events, in chunks of 37 bytes that cut characters and line breaks."""
    event = sse.encoded(F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("text"))
    turns = _turns(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("bytes")))).alias("t"))
    whole = F.aggregate("t", F.lit(b""), lambda acc, t: F.concat(acc, t["bytes"]))
    seq = F.posexplode(F.sequence(F.lit(1), F.greatest(F.octet_length("bytes"), F.lit(1)), F.lit(37))).alias("seq", "at")
    chunks = turns.select("stream_id", whole.alias("bytes")).select("stream_id", "bytes", seq)
    return sse.events(chunks.select("stream_id", "seq", F.substring(F.col("bytes"), F.col("at"), F.lit(37)).alias("bytes"))).drop("block")


@query("gold_source", "SELECT 'd' || n_nationkey AS id, 'k' || n_regionkey AS kind, 'Hallo ' || n_name || ' in Bonn' AS text, 6 AS start, (6 + length(n_name))::INT AS \"end\", 'PERSON' AS type, n_name AS value FROM nation")
def gold_source(spark, sf_dir):
    part = F.concat(F.lit("### id: d"), F.col("n_nationkey"), F.lit(" | kind: k"), F.col("n_regionkey"), F.lit("\nHallo {{PERSON:"), F.col("n_name"), F.lit("}} in Bonn\n\n"))
    source = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("Vorwort\n"), part).alias("source"))
    return gold.entities(gold.documents(source))


@query(
    "gold_problems",
    "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 1 THEN 'offsets' WHEN 2 THEN 'type' WHEN 3 THEN 'overlap' ELSE 'braces' END AS problem, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 7 ELSE 6 END::INT AS start FROM nation",
)
def gold_problems(spark, sf_dir):
    n, name = F.col("n_nationkey") % 4, F.col("n_name")
    entity = lambda start, text, kind: F.struct(F.lit(start).alias("start"), (F.lit(start) + F.char_length(text)).alias("end"), kind.alias("type"), text.alias("text"))
    first = entity(6, F.when(n == 1, F.upper(F.concat(F.lit("x"), F.substring(name, 2, 99)))).otherwise(name), F.when(n == 2, "NOBODY").otherwise("PERSON"))
    second = entity(7, F.substring(name, 2, 2), F.lit("PERSON"))
    text = F.concat(F.lit("Hallo "), name, F.when(n == 0, "}}").otherwise(""))
    docs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), text.alias("text"), F.when(n == 3, F.array(first, second)).otherwise(F.array(first)).alias("entities"))
    return gold.problems(docs, ["PERSON"])


@query("gold_type_counts", "SELECT CASE WHEN n_nationkey % 3 > 0 THEN 'T' || n_regionkey END AS type, count(*) AS n FROM nation GROUP BY 1")
def gold_type_counts(spark, sf_dir):
    some = F.when(F.col("n_nationkey") % 3 > 0, F.array(F.struct(F.concat(F.lit("T"), F.col("n_regionkey")).alias("type")))).otherwise(F.array().cast("array<struct<type:string>>"))
    return gold.type_counts(spark.read.parquet(f"{sf_dir}/nation.parquet").select(some.alias("entities")))


@query("json_spans", f"SELECT c_custkey AS doc_id, '{{\"start\":0,\"text\":\"' || c_name || '\",\"score\":0.9123}}' AS json FROM customer")
def json_spans(spark, sf_dir):
    row = F.struct(F.lit(0).alias("start"), F.col("c_name").alias("text"), F.round(F.lit(0.91234), 4).alias("score"))
    return synth.run_sql(spark, sf_dir, "SELECT c_custkey AS doc_id, c_name FROM customer").select("doc_id", F.to_json(row).alias("json"))


def _event(kind, **more):
    fields = [F.lit(f"response.{kind}").alias("type"), F.lit(99).alias("sequence_number"), *[v.alias(k) for k, v in more.items()]]
    return F.to_json(F.struct(*fields))


def _answer_events(spark, sf_dir):
    """One stream a customer: a text with a placeholder cut in three, a tool call in two fragments, a text that is never closed."""
    item = {"item_id": F.lit("m"), "content_index": F.lit(0)}
    whole = F.concat(F.lit("An [[PERSON_A1]], "), F.col("c_name"), F.lit("."))
    args = F.to_json(F.struct(F.lit("[[PERSON_A1]]").alias("to"), F.col("c_custkey").alias("n")))
    events = [
        _event("created"), _event("output_text.delta", delta=F.lit("An [[PER"), **item), _event("output_text.delta", delta=F.lit("SON_A"), **item), _event("output_text.delta", delta=F.concat(F.lit("1]], "), F.col("c_name"), F.lit(".")), **item),
        _event("output_text.done", text=whole, **item), _event("function_call_arguments.delta", item_id=F.lit("f"), delta=F.substring(args, 1, 9)), _event("function_call_arguments.delta", item_id=F.lit("f"), delta=F.substring(args, 10, 999)),
        _event("function_call_arguments.done", item_id=F.lit("f")), _event("output_text.delta", delta=F.lit("Ende [["), item_id=F.lit("n")), _event("completed"), F.lit("[DONE]"),
    ]
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("stream_id"), F.posexplode(F.array(*events)).alias("seq", "data"))


_VALUE = "c_name || ' \"x\"'"


@query(
    "responses_stream_events",
    f"""WITH e(n, type, delta) AS (VALUES (0, 'created', NULL), (1, 'output_text.delta', 'An '), (2, 'output_text.delta', ''), (3, 'output_text.delta', '{{v}}, {{n}}.'), (4, 'output_text.done', NULL),
        (5, 'function_call_arguments.delta', '{{a}}'), (6, 'function_call_arguments.done', NULL), (7, 'output_text.delta', 'Ende '), (8, 'output_text.delta', '[['), (9, 'completed', NULL), (NULL, NULL, NULL))
        SELECT c_custkey::VARCHAR AS stream_id, n::BIGINT AS number, 'response.' || type AS type, replace(replace(replace(delta, '{{a}}', '{{"to": ' || to_json({_VALUE}) || ', "n": ' || c_custkey || '}}'), '{{v}}', {_VALUE}), '{{n}}', c_name) AS delta,
          CASE type WHEN 'output_text.done' THEN 'An ' || {_VALUE} || ', ' || c_name || '.' END AS text FROM customer JOIN e ON true""",
)
def responses_stream_events(spark, sf_dir):
    """Events relayed with gapless numbers and whole placeholders, and restored by each stream's mapping."""
    events = responses.relayed_batch(_answer_events(spark, sf_dir).withColumn("seq", F.col("seq").cast("bigint"))).withColumnRenamed("stream_id", "mapping")
    names = spark.read.parquet(f"{sf_dir}/customer.parquet")
    entries = names.select(F.col("c_custkey").cast("string").alias("mapping"), F.lit("[[PERSON_A1]]").alias("placeholder"), F.concat("c_name", F.lit(' "x"')).alias("original"))
    back = bodies.restored_bodies(events, protocols.responses_event(), entries, body="data")
    get = lambda k: F.get_json_object("data", f"$.{k}")
    return back.select(F.col("mapping").alias("stream_id"), get("sequence_number").cast("bigint").alias("number"), get("type").alias("type"), get("delta").alias("delta"), get("text").alias("text"))
