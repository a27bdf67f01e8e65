"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come as VARIANT values of any layout. A record's fingerprint is the hash of its nested field paths (types and
array element order removed, keys in order); a declarative mapping is registered per fingerprint and turns the record
into canonical turns (role, text). The template writes each turn as `<|im_start|>role\\ntext<|im_end|>\\n`; control
strings inside roles and texts are escaped reversibly, so a text that quotes a template cannot forge a turn. The loss mask is
a list of spans, in code points and in bytes, that cover exactly the assistant texts. `read_back` parses a formatted
string and its mask into turns and the text under the mask.

Scale: everything is JVM code. Rows are gathered into conversations by one shuffle on conv_id, which formatting keeps;
a conversation is one output row and its size is the bound of every array here. Offsets are summed in blocks of BLOCK
turns, and spans are cut by byte offsets, so formatting and reading back are linear in the conversation's length (but for
one entry for each block, copied from block to block).

Defined cases: null text or role is empty; null turn numbers come first and rows equal in turn are ordered by role, then
text; repeated rows are turns of their own; rows with a null conv_id are one conversation; a record whose fingerprint no
mapping knows has null turns and is returned with `mapping` null, and `unmapped` counts such records by layout; empty
tables give only the extra conversations; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.llm.common import fresh, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that templates give meaning to.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TURNS = "array<struct<role:string,text:string>>"
#: Turns whose offsets are summed together.
BLOCK = 128
EXTRA = (-1, ("</s>[INST] ok [/INST]", "</s>[INST] ok [/INST]"))


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant: its schema with the types taken out."""
    paths = F.regexp_replace(F.schema_of_variant(record), r"(?<=[:<] ?)(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DATE|TIMESTAMP(_NTZ)?|BINARY|FLOAT|VARIANT|UUID|DECIMAL\([0-9,]+\))(?=[,>]|$)", "_")
    return F.xxhash64(paths)


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(record, '$.{path}', '{kind}')"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _list(path: str, role: str, text: str, names: dict[str, str] | None = None) -> str:
    said = f"coalesce(m.{role}, '')"
    if names:
        said = f"CASE {said} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {said} END"
    return f"transform({_get(path, f'array<struct<{role}:string,{text}:string>>')}, m -> {_turn(said, f'm.{text}')})"


def _said(role: str, path: str) -> str:
    return _turn(f"'{role}'", _get(path))


_PARTS = "array_join(transform(filter(m.content, p -> p.type = 'text' OR p.type IS NULL), p -> coalesce(p.text, '')), '')"
_NAMES = {"human": "user", "gpt": "assistant"}

#: name -> (example records of the layout as JSON, whose fields may be of any scalar type, SQL from `record` to turns)
MAPPINGS = {
    "messages": (
        [f'{{{top}"messages": [{{"role": "", "content": ""{extra}}}]}}' for top in ("", '"id": 0, ', '"source": "", ', '"id": 0, "source": "", ') for extra in ("", ', "name": ""', ', "weight": 0')],
        _list("messages", "role", "content"),
    ),
    "parts": (
        ['{"messages": [{"role": "", "content": [{"type": "", "text": ""}]}]}', '{"id": 0, "messages": [{"role": "", "content": [{"type": "", "text": ""}]}]}', '{"messages": [{"role": "", "content": [{"type": "", "text": "", "image_url": ""}]}]}'],
        f"transform({_get('messages', 'array<struct<role:string,content:array<struct<type:string,text:string>>>>')}, m -> named_struct('role', coalesce(m.role, ''), 'text', {_PARTS}))",
    ),
    "chat": (['{"id": 0, "chat": [{"role": "", "text": ""}]}', '{"chat": [{"role": "", "text": ""}]}'], _list("chat", "role", "text")),
    "turns": (['{"turns": [{"speaker": "", "utterance": ""}]}', '{"id": 0, "turns": [{"speaker": "", "utterance": ""}]}'], _list("turns", "speaker", "utterance", _NAMES)),
    "sharegpt": (['{"conversations": [{"from": "", "value": ""}]}', '{"id": 0, "conversations": [{"from": "", "value": ""}]}'], _list("conversations", "from", "value", _NAMES)),
    "sharegpt_system": (['{"system": "", "conversations": [{"from": "", "value": ""}]}'], f"concat(array({_said('system', 'system')}), {_list('conversations', 'from', 'value', _NAMES)})"),
    "dialog": (['{"dialog": [""]}', '{"id": 0, "dialog": [""]}'], f"transform({_get('dialog', 'array<string>')}, (t, i) -> named_struct('role', if(i % 2 = 0, 'user', 'assistant'), 'text', coalesce(t, '')))"),
    "prompt": (['{"prompt": "", "completion": ""}', '{"id": 0, "prompt": "", "completion": ""}'], f"array({_said('user', 'prompt')}, {_said('assistant', 'completion')})"),
    "response": (['{"prompt": "", "response": ""}', '{"id": 0, "prompt": "", "response": ""}'], f"array({_said('user', 'prompt')}, {_said('assistant', 'response')})"),
    "preference": (['{"prompt": "", "chosen": "", "rejected": ""}'], f"array({_said('user', 'prompt')}, {_said('assistant', 'chosen')})"),
    "question": (['{"question": "", "answer": ""}', '{"id": 0, "question": "", "answer": ""}'], f"array({_said('user', 'question')}, {_said('assistant', 'answer')})"),
    "instruction": (
        ['{"instruction": "", "input": "", "output": ""}', '{"instruction": "", "output": ""}'],
        "array(" + _turn("'user'", f"concat_ws('\n\n', {_get('instruction')}, nullif({_get('input')}, ''))") + f", {_said('assistant', 'output')})",
    ),
    "system_prompt": (['{"system": "", "prompt": "", "completion": ""}'], f"array({_said('system', 'system')}, {_said('user', 'prompt')}, {_said('assistant', 'completion')})"),
    "empty_messages": (['{"messages": []}'], f"CAST(array() AS {TURNS})"),
}


def canonical(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """Adds fingerprint, mapping and turns to rows with a variant column `record`."""
    spark = records.sparkSession
    examples = [(name, e) for name, (them, _) in mappings.items() for e in them]
    marks = spark.range(1).select(F.array(*[fingerprint(F.try_parse_json(F.lit(e))) for _, e in examples])).first()[0]
    out = records.withColumn("fingerprint", fingerprint(F.col("record")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for k, (_, sql) in mappings.items():
        here = F.col("fingerprint").isin([m for m, (n, _) in zip(marks, examples) if n == k])
        name, turns = F.when(here, F.lit(k)).otherwise(name), F.when(here, F.expr(sql).cast(TURNS)).otherwise(turns)
    return out.withColumn("mapping", name).withColumn("turns", turns)


def unmapped(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """fingerprint, layout, n_records: what no mapping knows."""
    left = canonical(records, mappings).where("mapping IS NULL")
    return left.groupBy("fingerprint").agg(F.min(F.schema_of_variant("record")).alias("layout"), F.count(F.lit(1)).alias("n_records"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\|[]<>/()" else c for c in s)


def _tails(first: str) -> str:
    return "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == first)


def escape(text: Column) -> Column:
    """No control string is left: a backslash is doubled, the first character of a control string becomes \\l or \\b."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, f"<(?={_tails('<')})", r"\\l")
    return F.regexp_replace(out, rf"\[(?={_tails('[')})", r"\\b")


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n"))), "\\")


def _escaped_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def with_format(df: DataFrame) -> DataFrame:
    """Adds `formatted` to rows with `turns`, a struct(text, loss): the formatted conversation and its loss spans (first
    code point, code points, first byte, bytes; from 0). Each step is a column, so that none is computed twice."""
    marked, sized, blocks, begin = fresh(df, "marked", "sized", "blocks", "begin")
    head = lambda t: F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n"))
    tail, long = len(END) + 1, lambda x: x.cast("long")
    span = "struct<at:bigint,n:bigint,at_byte:bigint,n_bytes:bigint>"
    zero = F.expr(f"named_struct('c', 0L, 'b', 0L, 'spans', CAST(array() AS array<{span}>))")

    def add(acc: Column, m: Column) -> Column:
        one = F.array(F.struct((acc["c"] + m["hc"]).alias("at"), m["bc"].alias("n"), (acc["b"] + m["hb"]).alias("at_byte"), m["bb"].alias("n_bytes")))
        return F.struct((acc["c"] + m["hc"] + m["bc"] + tail).alias("c"), (acc["b"] + m["hb"] + m["bb"] + tail).alias("b"), F.when(m["loss"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    df = df.withColumn(marked, F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))))
    df = df.withColumn(sized, F.transform(marked, lambda m: F.struct(
        long(F.char_length(m["head"])).alias("hc"), long(F.octet_length(m["head"])).alias("hb"), long(F.char_length(m["body"])).alias("bc"), long(F.octet_length(m["body"])).alias("bb"), m["loss"].alias("loss"))))
    # spans within blocks of turns, then where each block begins
    starts = F.when(F.size(sized) > 0, F.sequence(F.lit(1), F.greatest(F.size(sized), F.lit(1)), F.lit(BLOCK))).when(F.size(sized) == 0, F.array().cast("array<int>"))
    df = df.withColumn(blocks, F.transform(starts, lambda i: F.aggregate(F.slice(sized, i, F.lit(BLOCK)), zero, add)))
    df = df.withColumn(begin, F.aggregate(
        blocks, F.expr("named_struct('c', 0L, 'b', 0L, 'at', CAST(array() AS array<struct<c:bigint,b:bigint>>))"),
        lambda acc, k: F.struct((acc["c"] + k["c"]).alias("c"), (acc["b"] + k["b"]).alias("b"), F.concat(acc["at"], F.array(F.struct(acc["c"].alias("c"), acc["b"].alias("b")))).alias("at")),
        lambda acc: acc["at"],
    ))
    moved = F.zip_with(blocks, begin, lambda k, to: F.transform(k["spans"], lambda x: F.struct((x["at"] + to["c"]).alias("at"), x["n"].alias("n"), (x["at_byte"] + to["b"]).alias("at_byte"), x["n_bytes"].alias("n_bytes"))))
    text = F.array_join(F.transform(marked, lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "")
    return df.withColumn("formatted", F.struct(text.alias("text"), F.flatten(moved).alias("loss"))).drop(marked, sized, blocks, begin)


def read_turns(text: Column) -> Column:
    """Canonical turns from a formatted string."""
    pieces = F.filter(F.split(text, _quoted(END) + "\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(body(p), "\n", 1)).alias("role"),
            unescape(F.substring(body(p), F.instr(body(p), F.lit("\n")) + 1, F.char_length(p))).alias("text"),
        ),
    )


def under_mask(text: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, nothing between the spans."""
    # the bytes reach the lambda as an element, repeated by reference: an outer expression would be computed for each span
    raw = F.array_repeat(F.encode(text, "UTF-8"), F.size(loss))
    cut = lambda s, r: F.decode(F.substring(r, (s["at_byte"] + 1).cast("int"), s["n_bytes"].cast("int")), "UTF-8")
    return F.array_join(F.zip_with(loss, raw, lambda s, r: unescape(cut(s, r))), "")


def digest(df: DataFrame) -> DataFrame:
    """conv_id, formatted -> the digests of what reading back gives."""
    read = df.select("conv_id", F.col("formatted.text").alias("_f"), read_turns(F.col("formatted.text")).alias("_turns"), under_mask(F.col("formatted.text"), F.col("formatted.loss")).alias("_loss"))
    all_text = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("_f").cast("long").alias("formatted_chars"),
    )


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records (conv_id, record) in the layouts that their shapes are shipped in: a
    lone user and assistant pair as one of three pair layouts, with a leading system text as system_prompt; of the others
    those with user and assistant turns only as dialog, if they alternate, or sharegpt, and the rest as messages, parts or
    chat. Where several fit, conv_id chooses."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    convs = convs.withColumn("_roles", F.transform("_t", lambda t: t["role"])).withColumn("_k", F.coalesce(F.pmod(F.hash("conv_id"), F.lit(3)), F.lit(0)))
    at = lambda i: F.element_at("_t", i)["content"]
    obj = lambda *cols: F.to_variant_object(F.struct(*cols))
    each = lambda *fields: F.transform("_t", lambda t: F.struct(*[f(t) for f in fields]))
    role, text = (lambda name: lambda t: t["role"].alias(name)), (lambda name: lambda t: t["content"].alias(name))
    known = F.size(F.array_except("_roles", F.array(F.lit("user"), F.lit("assistant")))) == 0
    alternating = F.forall(F.transform("_roles", lambda r, i: r == F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))), lambda x: x)
    pair, k = F.col("_roles") == F.array(F.lit("user"), F.lit("assistant")), F.col("_k")
    named = lambda t: F.when(t["role"] == "user", F.lit("human")).otherwise(F.lit("gpt")).alias("from")
    parts = lambda t: F.array(F.struct(F.lit("text").alias("type"), t["content"].alias("text"))).alias("content")
    record = (
        F.when(pair & (k == 0), obj(at(1).alias("prompt"), at(2).alias("completion")))
        .when(pair & (k == 1), obj(at(1).alias("instruction"), F.lit("").alias("input"), at(2).alias("output")))
        .when(pair, obj(at(1).alias("question"), at(2).alias("answer")))
        .when(F.col("_roles") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), obj(at(1).alias("system"), at(2).alias("prompt"), at(3).alias("completion")))
        .when(known & alternating & (k == 0), obj(F.transform("_t", lambda t: t["content"]).alias("dialog")))
        .when(known & (k == 1), obj(each(named, text("value")).alias("conversations")))
        .when(k == 0, obj(each(role("role"), text("content")).alias("messages")))
        .when(k == 1, obj(each(role("role"), parts).alias("messages")))
        .otherwise(obj(each(role("role"), text("text")).alias("chat")))
    )
    return convs.select("conv_id", record.alias("record"))


def format_records(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """records: any columns and `record`. Adds fingerprint, mapping, turns and formatted (text, loss)."""
    return with_format(canonical(records, mappings))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, (user, assistant) = EXTRA
    extra = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(conv).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for i, (r, t) in enumerate((("user", user), ("assistant", assistant)))])))
    return digest(format_records(conversations(rows.unionByName(extra))).select("conv_id", "formatted"))


def chat_sql() -> str:
    # the formatted length: every turn adds the marks, its role and its escaped text
    q = lambda s: s.replace("'", "''")
    esc = "replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        esc = f"replace({esc}, '{q(c)}', '{'~' + q(c)}')"  # one more code point for each control string
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXTRA[1][0]}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA[1][1]}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS a,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS l,
  sum(length({esc.format(x="role")}) + length(role) - length(replace(role, chr(10), '')) + length({esc.format(x="text")}) + {len(START) + len(END) + 2}) AS f FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(a) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g"""


QUERIES = {"op2_chat": op2_chat}
ORACLE = {"op2_chat": chat_sql()}
