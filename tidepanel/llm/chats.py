"""Chat formatting with native functions.

Records come in many layouts: a prompt and its completion, an instruction with an input, lists of messages under various
names. The nested field paths of a record, whatever its values, are written in one canonical form and hashed; that
fingerprint selects a declarative layout, which says where the turns are. Turns are written with a template whose control
strings are escaped inside roles and texts, and can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
OPEN, CLOSE = "<s>", "</s>"
#: A control string: its first character, then the rest. One backslash more between the two makes it plain text.
_CONTROL = r"(<)(\\*)(/?s>|\||<SYS>>|</SYS>>)|(\[)(\\*)(/?INST\])"
_ESCAPED = r"(<)\\(\\*)(/?s>|\||<SYS>>|</SYS>>)|(\[)\\(\\*)(/?INST\])"


def escape(x: Column) -> Column:
    """Every control string, plain or already with backslashes, gets one backslash after its first character."""
    return F.regexp_replace(x, _CONTROL, r"$1$4\\$2$5$3$6")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPED, r"$1$4$2$5$3$6")


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    `turns`: (role, field, further fields) for records with one field per turn, missing or null fields giving no turn and
    further fields being added after a blank line; or, with `each`, that list's items hold role and text in the fields
    `role` and `text`. `optional` names fields that a record may lack; other fields of the same list may be ignored by
    naming them in `ignored`, present or not.
    """
    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    as_given: bool = False      # roles are canonical already

    def signatures(self) -> list[str]:
        """Every canonical form of field paths that belongs to this layout."""
        free = (*self.optional, *self.ignored)
        subsets = list(chain.from_iterable(combinations(free, k) for k in range(len(free) + 1)))
        if self.each:
            inner, outer = (self.role, self.text), [f for f in free if not f.startswith(self.each + "[].")]
            items = [f.removeprefix(self.each + "[].") for f in free if f.startswith(self.each + "[].")]
            item_sets = chain.from_iterable(combinations(items, k) for k in range(len(items) + 1))
            lists = ["ARRAY<>", *[f"ARRAY<{_object({f: '' for f in (set(inner) - set(items)) | set(some)})}>" for some in item_sets]]
            return sorted({_object({self.each: of, **{f: "" for f in some}}) for of in lists
                           for some in chain.from_iterable(combinations(outer, k) for k in range(len(outer) + 1))})
        needed = {f for _, fields in self.turns for f in fields} - set(free)
        return sorted({_object({f: "" for f in needed | set(some)}) for some in subsets} - {_object({})})


def _object(fields: dict[str, str]) -> str:
    return "OBJECT<" + ", ".join(k + (f": {v}" if v else "") for k, v in sorted(fields.items())) + ">"


#: One turn of a table with a row for each turn.
TURN_ROW = Layout("turn row", turns=(("", ("text",)),), optional=("text", "role", "turn"), as_given=True)
LAYOUTS = (
    TURN_ROW,
    Layout("messages", each="messages", optional=("id",), ignored=("messages[].name",)),
    Layout("from and value", each="conversations", role="from", text="value", optional=("id",)),
    Layout("dialogue", each="dialogue", role="speaker", text="text", optional=("id",)),
    Layout("prompt and completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system", "id")),
    Layout("prompt and response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system", "id")),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input", "system", "id")),
    Layout("question and answer", turns=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context", "id")),
)
#: Other names of the three roles, lower case.
ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant",
         "ai": "assistant", "developer": "system"}


def field_paths(record: Column) -> Column:
    """Canonical form of a variant's nested field paths: names sorted at each level, lists merged, no types or values."""
    typed = F.schema_of_variant(record)
    bare = F.regexp_replace(typed, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?(?=[,>])", "")
    return F.regexp_replace(bare, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?>", "ARRAY<>")


def _path(*fields: str) -> str:
    return "$" + "".join(f"['{f}']" for f in fields)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, layout: Layout) -> Column:
    get = lambda v, f: F.try_variant_get(v, _path(f), "string")
    if layout is TURN_ROW:
        return F.array(_turn(get(record, "role"), get(record, "text")))
    if layout.each:
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        def named(r: Column) -> Column:
            low = F.lower(F.trim(r))
            return F.coalesce(F.try_element_at(names, low), low)
        return F.transform(F.try_variant_get(record, _path(layout.each), "array<variant>"),
                           lambda v: _turn(get(v, layout.role) if layout.as_given else named(get(v, layout.role)), get(v, layout.text)))
    turns = [F.when(reduce(lambda a, b: a | b, [get(record, f).isNotNull() for f in fields]),
                    _turn(F.lit(role), F.concat_ws("\n\n", *[F.nullif(get(record, f), F.lit("")) for f in fields]))) for role, fields in layout.turns]
    return F.array_compact(F.array(*turns))


def read_layouts(df: DataFrame, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds `fingerprint` (of the field paths), `layout` (its name) and `turns` (array of role and text).

    `record` is a variant, or a string of JSON. A null record, one that is no JSON, and a layout not listed give a null
    `layout` and no turns, and the row stays; the fingerprint then shows which layouts to add. Null roles and texts are
    empty; an empty list of messages has no turns. Values of another type than text are written as text. One record is
    one value of at most 128 MiB. Columns of the output's names are replaced; an empty table stays empty.
    """
    seen: dict[str, str] = {}
    for layout in layouts:
        for s in layout.signatures():
            if s in seen and seen[s] != layout.name:
                raise ValueError(f"layouts {seen[s]} and {layout.name} have the same field paths {s}")
            seen[s] = layout.name
    read = df.withColumn("_record", record)
    if read.schema["_record"].dataType.typeName() != "variant":
        read = read.withColumn("_record", F.try_parse_json("_record"))
    read = without(read, "fingerprint", "layout", "turns").withColumn("fingerprint", F.when(F.col("_record").isNotNull(), F.xxhash64(field_paths(F.col("_record")))))
    known = lambda one: F.col("fingerprint").isin(*[F.xxhash64(F.lit(s)) for s in one.signatures()])
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for one in reversed(layouts):
        name = F.when(known(one), F.lit(one.name)).otherwise(name)
    read = read.withColumn("layout", name)
    for one in reversed(layouts):
        turns = F.when(F.col("layout") == one.name, _turns(F.col("_record"), one)).otherwise(turns)
    return read.withColumn("turns", F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>"))).drop("_record")


def render(turns: Column) -> tuple[Column, Column]:
    """(formatted, loss): the conversation as one string, and for each turn the half-open span of code points, counted
    from the turn's mark, that is under the loss mask (null: none). Under the mask are the texts of assistant turns."""
    formatted = F.concat(F.lit(OPEN), F.concat_ws("", F.transform(turns, lambda t: F.concat(
        F.lit(TURN), escape(t["role"]), F.lit(SAYS), escape(t["text"]), F.lit(END)))), F.lit(CLOSE))
    before = lambda t: F.length(escape(t["role"])) + len(TURN) + len(SAYS)
    loss = F.transform(turns, lambda t: F.when(t["role"] == "assistant", F.struct(
        before(t).alias("start"), (before(t) + F.length(escape(t["text"]))).alias("end"))))
    return formatted, loss


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand, each from after its mark."""
    inner = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))
    parts = F.split(inner, r"<\|turn\|>")
    return F.slice(parts, F.lit(2), F.size(parts) - 1)


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    return F.transform(pieces(formatted), lambda p: F.struct(
        unescape(F.substring_index(p, SAYS, 1)).alias("role"),
        unescape(F.substring_index(F.substring(p, F.instr(p, SAYS) + len(SAYS), F.length(p)), END, 1)).alias("text")))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """What lies under the loss mask, turn by turn, unescaped."""
    return F.array_compact(F.zip_with(pieces(formatted), loss, lambda p, m: F.when(
        m.isNotNull(), unescape(F.substring(p, m["start"] - len(TURN) + 1, m["end"] - m["start"])))))


def format_turn_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: the column `conv`, `formatted` and `loss` (see `render`).

    `rows` holds a row for each turn. Turns follow `turn` (null first), ties by role, then text; repeated rows are turns
    of their own. Null texts and roles are empty; a null `conv` is a conversation too; other columns are ignored. An empty table
    gives no conversation. A formatted conversation is one value, so one task holds the turns of a conversation (up to
    Spark's 2 GB a value); rows are read and laid out before that, wherever they lie.
    """
    one = rows.select(F.col(f"`{conv}`").alias("_conv"), F.col(f"`{turn}`").alias("_turn"), F.to_variant_object(F.struct(
        F.col(f"`{turn}`").cast("string").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))).alias("_rec"))
    laid = read_layouts(one, F.col("_rec")).select("_conv", "_turn", F.explode("turns").alias("t"))
    whole = laid.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text")))).alias("turns"))
    formatted, loss = render(F.col("turns"))
    return whole.select(F.col("_conv").alias(conv), formatted.alias("formatted"), loss.alias("loss"))


def chats_sql() -> str:
    """DuckDB: the digest columns of op12, from the rows themselves."""
    esc = lambda x: rf"""regexp_replace({x}, '(<)(\\*)(/?s>|\||<SYS>>|</SYS>>)|(\[)(\\*)(/?INST\])', '\1\4' || chr(92) || chr(92) || '\2\5\3\6', 'g')"""
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
        CAST({len(OPEN) + len(CLOSE)} + sum({len(TURN) + len(SAYS) + len(END)} + length({esc('role')}) + length({esc('text')})) AS BIGINT) AS formatted_chars
       FROM r GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""
