"""Chat formatting: schema fingerprints choose how a record becomes turns; a template marks them.

A record is one JSON object, or a struct column whose paths are those of its type: then
nothing is parsed, and a text may be as long as a row allows (a JSON string of more than
20,000,000 characters is not parsed and has no layout).  Those of its nested field paths that any layout declares are
hashed, without types; the hash selects one of the layouts, which says where roles and texts
are.  Other fields (ids, sources, names of turns) change nothing.  A content that is a list of
parts with texts is their concatenation.  Records whose hash no layout declares keep an empty
list of turns and a null layout; formatted, each is one row with its raw record.

The template writes a turn as ``<s>[INST] role [/INST]text</s>``.  Control strings inside
roles and texts get a backslash after their first character (one more where there are some
already), which reading back removes, so any text survives.  The loss mask covers the texts
of assistant turns.  A conversation is the formatted turns in order; each turn is a row, so
no conversation has to fit into one row.

The digests of a conversation count the records that gave no turn in ``n_unread``; a
conversation of such records alone has no digest.  An empty table has no rows; columns that
are not named are not read.  Null or missing roles and texts are empty.  Ties in a conversation's order are broken by the
formatted turn; repeated rows are turns of their own; a null conv_id is a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import small_batches

_TURNS = "array<struct<role:string,text:string>>"


def _parts(owner: Column, field: str) -> Column:
    return F.transform(F.try_variant_get(owner, f"$.{field}", "array<variant>"), lambda p: F.try_variant_get(p, "$.text", "string"))


def _text(owner: Column, field: str) -> Column:
    """A field's text; that of a list of parts is their concatenation."""
    return F.coalesce(F.array_join(_parts(owner, field), ""), F.try_variant_get(owner, f"$.{field}", "string"))


def _named(owner: Column, field: str) -> Column:
    """The field's name if it is there, with a mark if its value is neither scalar nor a list of texts."""
    value = F.try_variant_get(owner, f"$.{field}", "variant")
    nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)<")
    texts = F.coalesce(F.forall(_parts(owner, field), lambda t: t.isNotNull()), F.lit(False))
    return F.when(value.isNotNull(), F.when(nested & ~texts, F.lit(f"{field}: ?")).otherwise(F.lit(field)))


def _marks(turns: Column, field: str) -> Column:
    return F.transform(turns, lambda t: _named(t, field))


def _object(names: list[Column]) -> Column:
    return F.concat(F.lit("OBJECT<"), F.array_join(F.array(*names), ", "), F.lit(">"))


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are: a list of turn objects, or fields that are turns themselves.

    ``fields`` of a list layout are its role and text field; of a plain layout, pairs of a
    role and a field.  A plain layout without roles has the role in the field ``role_field``.
    Fields in ``optional`` may be absent.
    """

    name: str
    fields: tuple
    list_field: str | None = None
    role_field: str | None = None
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def signatures(self) -> list[str]:
        if self.list_field:
            names = sorted(self.fields)
        else:
            names = sorted({f for _, f in self.fields} | ({self.role_field} if self.role_field else set()))
        out = []
        for held in product(*[(True, False) if n in self.optional else (True,) for n in names]):
            inner = "OBJECT<" + ", ".join(n for n, h in zip(names, held) if h) + ">"
            out.append(f"OBJECT<{self.list_field}: ARRAY<{inner}>>" if self.list_field else inner)
        return out

    def fingerprints(self) -> list[str]:
        return [hashlib.sha256(s.encode()).hexdigest() for s in self.signatures()]

    def turns(self, record: Column) -> Column:
        if self.list_field:
            role, text = self.fields
            listed = F.try_variant_get(record, f"$.{self.list_field}", "array<variant>")
            names = F.create_map(*[F.lit(x) for pair in self.roles for x in pair]) if self.roles else None

            def one(turn: Column) -> Column:
                said = F.try_variant_get(turn, f"$.{role}", "string")
                named = said if names is None else F.coalesce(names[said], said)
                return F.struct(named.alias("role"), _text(turn, text).alias("text"))

            return F.transform(listed, one)

        def of(role: str | None, field: str) -> Column:
            named = F.lit(role) if role else F.try_variant_get(record, f"$.{self.role_field}", "string")
            return F.struct(named.alias("role"), _text(record, field).alias("text"))

        single = len(self.fields) == 1
        turns = F.array(*[of(role, field) for role, field in self.fields])
        return turns if single else F.filter(turns, lambda t: t["text"].isNotNull())


LAYOUTS = (
    Layout("turn", ((None, "text"),), role_field="role", optional=("role", "text")),
    Layout("messages", ("role", "content"), list_field="messages", optional=("content",)),
    Layout("exchanges", ("from", "value"), list_field="conversations", optional=("value",),
           roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=("system", "input")),
    Layout("completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("answer", (("user", "question"), ("assistant", "answer"))),
)


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the declared field paths of a parsed record; scalar types do not count.

    A record without any declared path has the hash of all its own paths.
    """
    lists = {x.list_field: x for x in layouts if x.list_field}
    plain = {f for x in layouts if not x.list_field for f in (*[f for _, f in x.fields], x.role_field) if f}
    names = []
    for name in sorted(plain | set(lists)):
        if name not in lists:
            names.append(_named(record, name))
            continue
        value = F.try_variant_get(record, f"$.{name}", "variant")
        turns = F.try_variant_get(record, f"$.{name}", "array<variant>")
        held = []
        for field in sorted(lists[name].fields):
            marks = _marks(turns, field)
            held.append(F.when(F.array_contains(marks, f"{field}: ?"), F.lit(f"{field}: ?"))
                        .when(F.array_contains(marks, field), F.lit(field)))
        inner = F.concat(F.lit(f"{name}: ARRAY<"), _object(held), F.lit(">"))
        objects = F.schema_of_variant(value).startswith("ARRAY<OBJECT<")
        names.append(F.when(value.isNotNull(), F.when(objects, inner).otherwise(F.lit(f"{name}: ?"))))
    whole = F.schema_of_variant(record)
    declared = F.size(F.array_compact(F.array(*names))) > 0
    return F.sha2(F.when(declared & whole.startswith("OBJECT<"), _object(names)).otherwise(whole), 256)


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` (null if none is declared for the record's fingerprint) and ``turns``.

    The record is JSON text, or a struct; a null struct has no turns.
    """
    kind = records.schema[record_col].dataType
    if isinstance(kind, T.StructType):
        layout, record = typed_layout(kind, layouts), F.col(record_col)
        none = F.array().cast(_TURNS)
        turns = none if layout is None else F.when(record.isNotNull(), F.coalesce(_typed_turns(record, kind, layout).cast(_TURNS), none)).otherwise(none)
        return records.withColumns({"layout": F.lit(layout.name if layout else None).cast("string"), "turns": turns})
    parsed = records.withColumn("_parsed", F.try_parse_json(record_col))
    parsed = parsed.withColumn("_print", fingerprint(F.col("_parsed"), layouts))
    name, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for layout in layouts:
        known = F.col("_print").isin(layout.fingerprints())
        name = F.when(known, F.lit(layout.name)).otherwise(name)
        turns = F.when(known, layout.turns(F.col("_parsed")).cast(_TURNS)).otherwise(turns)
    return parsed.withColumns({"layout": name, "turns": turns}).drop("_parsed", "_print")


def _typed_signature(schema: T.StructType, layouts: tuple[Layout, ...]) -> str:
    """The declared paths of a struct type, written as ``fingerprint`` writes those of a record."""
    lists = {x.list_field: x for x in layouts if x.list_field}
    plain = {f for x in layouts if not x.list_field for f in (*[f for _, f in x.fields], x.role_field) if f}

    def scalar(field: T.StructField) -> str:
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        return f"{field.name}: ?" if nested else field.name

    names = []
    for field in sorted(schema.fields, key=lambda f: f.name):
        if field.name in lists:
            inner = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else None
            if not isinstance(inner, T.StructType):
                names.append(f"{field.name}: ?")
                continue
            held = [scalar(f) for f in sorted(inner.fields, key=lambda f: f.name) if f.name in lists[field.name].fields]
            names.append(f"{field.name}: ARRAY<OBJECT<{', '.join(held)}>>")
        elif field.name in plain:
            names.append(scalar(field))
    return f"OBJECT<{', '.join(names)}>"


def typed_layout(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout whose fingerprint a struct type has."""
    signature = _typed_signature(schema, layouts)
    if signature == "OBJECT<>" and schema.fields:
        return None
    found = hashlib.sha256(signature.encode()).hexdigest()
    return next((x for x in reversed(layouts) if found in x.fingerprints()), None)


def _typed_turns(record: Column, schema: T.StructType, layout: Layout) -> Column:
    """Turns of a struct by its layout; fields that the type does not have are null."""
    def field(owner: Column, kind: T.StructType, name: str | None) -> Column:
        return owner[name].cast("string") if name in kind.fieldNames() else F.lit(None).cast("string")

    if layout.list_field:
        inner = schema[layout.list_field].dataType.elementType
        role, text = layout.fields
        names = F.create_map(*[F.lit(x) for pair in layout.roles for x in pair]) if layout.roles else None

        def one(turn: Column) -> Column:
            said = field(turn, inner, role)
            return F.struct((said if names is None else F.coalesce(names[said], said)).alias("role"), field(turn, inner, text).alias("text"))

        return F.transform(record[layout.list_field], one)
    turns = F.array(*[
        F.struct((F.lit(role) if role else field(record, schema, layout.role_field)).alias("role"), field(record, schema, name).alias("text"))
        for role, name in layout.fields])
    return turns if len(layout.fields) == 1 else F.filter(turns, lambda t: t["text"].isNotNull())


_CONTROL = r"(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss``, an array of (start, length) in code points, per turn row.

    ``turns`` has role and text columns.
    """
    head = F.concat(F.lit("<s>[INST] "), escape(F.coalesce("role", F.lit(""))), F.lit(" [/INST]"))
    text = escape(F.coalesce("text", F.lit("")))
    span = F.struct(F.length(head).alias("start"), F.length(text).alias("length"))
    return turns.withColumns({
        "formatted": F.concat(head, text, F.lit("</s>")),
        "loss": F.when(F.col("role") == "assistant", F.array(span)).otherwise(F.array().cast("array<struct<start:int,length:int>>")),
    })


_BACK = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
         "formatted_chars bigint, n_unread bigint")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come conversation by conversation, in order; only running hashes are kept."""
    done: list[tuple] = []
    current: tuple | None = None
    n = loss_chars = chars = unread = 0
    whole = loss = None

    def close() -> None:
        if n:
            done.append((current[0], n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, unread))

    def rows() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_unread"]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        done.clear()
        return out

    for batch in small_batches(batches, "formatted"):
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if current != (conv,):
                if current:
                    close()
                current, n, loss_chars, chars, unread = (conv,), 0, 0, 0, 0
                whole, loss = hashlib.sha256(), hashlib.sha256()
            if text is None:
                unread += 1
                continue
            for role, said in _TURN.findall(text):
                whole.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                n += 1
            for span in spans:
                part = unescape(text[span["start"]: span["start"] + span["length"]])
                loss.update(part.encode())
                loss_chars += len(part)
            chars += len(text)
        if done:
            yield rows()
    if current:
        close()
        if done:
            yield rows()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, parsed from their formatted turns.

    ``formatted`` has conv_id, turn, place, formatted and loss.  A digest of a whole
    conversation has to run through it in order; one task streams it and keeps hashes only.
    Records without turns are counted in ``n_unread`` of their conversation.
    """
    return (
        formatted.select("conv_id", "turn", "place", "formatted", "loss")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "formatted")
        .select("conv_id", "formatted", "loss").mapInArrow(_digest, _BACK)
    )


def format_records(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", record_col: str = "record") -> DataFrame:
    """conv_id, turn, place, layout, role, text, formatted, loss and record: a row for every turn of every record.

    A record without turns is one row with null place, formatted and loss, and the ``record``
    (a struct as JSON text).
    """
    typed = isinstance(records.schema[record_col].dataType, T.StructType)
    known = canonical_turns(records.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(record_col).alias("record")))
    turns = known.select("conv_id", "turn", "layout", "record", F.posexplode_outer("turns").alias("place", "said"))
    there = F.col("place").isNotNull()
    made = format_turns(turns.select("conv_id", "turn", "place", "layout", "said.*", "record"))
    return made.select("conv_id", "turn", "place", "layout", "role", "text", F.when(there, F.col("formatted")).alias("formatted"),
                       F.when(there, F.col("loss")).alias("loss"), F.when(~there, F.to_json("record") if typed else F.col("record")).alias("record"))
