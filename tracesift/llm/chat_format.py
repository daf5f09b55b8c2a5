r"""Chat formatting that is proved by reading it back.

The template writes an assistant's turn as ``<s>role\ntext</s>`` and any other as ``[INST] role\ntext
[/INST]``, one after the other.  A deterministic parser reads turns back from the formatted text.  A
conversation is first written as it is; if what is read back differs from the source, it is written again
with its conflicts escaped, one step further each time, until both are identical:

- step 0 escapes nothing;
- step 1 puts a backslash into every control string within a role or text, also into those that have some
  already, so that taking one out again gives the source;
- step 2 also writes line breaks and backslashes of roles as ``\n`` and ``\\``.

Step 2 conflicts with nothing; a difference after it would fail the job.  The first characters of the
output name the step.  A loss mask gives the places of the assistants' texts in the output.

Inputs: null roles and texts count as empty.  Turns are ordered by number (null first), then role, then
text; repeated rows are turns of their own.  Rows whose conversation is null are one conversation.  A
conversation is one output row, so its turns meet in one task: its size bounds that task's memory.  An
empty table gives an empty table; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.functions.folds import compute_once, let, running

ASSISTANT = "assistant"
STEPS = 3

_ASK, _ASK_END, _SAY, _SAY_END = "[INST] ", " [/INST]", "<s>", "</s>"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>"
_CONTROL = r"([\[<])(\\*)(/?(?:INST\]|s>))"
_ESCAPED = r"([\[<])\\(\\*)(/?(?:INST\]|s>))"
_TURNS = "array<struct<role:string,text:string>>"


def heading(step: int) -> str:
    """What an output of this step starts with; no turn starts like that."""
    return f"<{'\\' * step}>" if step else ""


def escaped(text: Column, step: int, is_role: bool = False) -> Column:
    if step > 1 and is_role:
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3") if step else text


def unescaped(text: Column, step: Column | int, is_role: bool = False) -> Column:
    step = F.lit(step) if isinstance(step, int) else step
    plain = F.when(step > 0, F.regexp_replace(text, _ESCAPED, "$1$2$3")).otherwise(text)
    if not is_role:
        return plain
    pieces = F.transform(F.split(plain, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.when(step > 1, F.array_join(pieces, "\\")).otherwise(plain)


def render(turns: Column, step: int) -> Column:
    """All turns by the template, with conflicts escaped up to ``step``."""
    def turn(t: Column) -> Column:
        inner = F.concat(escaped(t["role"], step, True), F.lit("\n"), escaped(t["text"], step))
        said = F.concat(F.lit(_SAY), inner, F.lit(_SAY_END))
        return F.when(t["role"] == ASSISTANT, said).otherwise(F.concat(F.lit(_ASK), inner, F.lit(_ASK_END)))

    return F.concat(F.lit(heading(step)), F.array_join(F.transform(turns, turn), ""))


def step_of(formatted: Column) -> Column:
    return F.length(F.regexp_extract(formatted, r"^<(\\*)>", 1))


def written_turns(formatted: Column) -> Column:
    """The turns of an output as they stand there."""
    return F.regexp_extract_all(F.regexp_replace(formatted, r"^<\\+>", ""), F.lit(_TURN), F.lit(0))


def _inner(turn: Column) -> Column:
    spoken = F.startswith(turn, F.lit(_SAY))
    before = F.when(spoken, len(_SAY)).otherwise(len(_ASK))
    around = F.when(spoken, len(_SAY + _SAY_END)).otherwise(len(_ASK + _ASK_END))
    return F.substring(turn, before + 1, F.length(turn) - around)


def parse(formatted: Column) -> Column:
    """The turns read back from an output; null if anything is left between or beside them."""
    def turn(t: Column) -> Column:
        inner, step = _inner(t), step_of(formatted)
        role = F.substring_index(inner, "\n", 1)
        text = F.substring(inner, F.length(role) + 2, F.length(inner))
        return F.struct(unescaped(role, step, True).alias("role"), unescaped(text, step).alias("text"))

    found = written_turns(formatted)
    whole = F.concat(F.regexp_extract(formatted, r"^<\\+>", 0), F.array_join(found, "")) == formatted
    return F.when(whole, F.transform(found, turn))


def loss_mask(formatted: Column) -> Column:
    """Start (characters before it) and length of every assistant's text, as escaped in the output."""
    def spans(turns: Column) -> Column:
        ends = running(turns, lambda at, t: at + F.length(t))
        step = step_of(formatted)

        def span(t: Column, end: Column) -> Column:
            role = F.substring_index(_inner(t), "\n", 1)
            spoken = F.startswith(t, F.lit(_SAY)) & (unescaped(role, step, True) == ASSISTANT)
            length = F.length(_inner(t)) - F.length(role) - 1
            start = F.length(F.regexp_extract(formatted, r"^<\\+>", 0)) + end - len(_SAY_END) - length
            return F.struct(F.when(spoken, start).cast("long").alias("start"), length.cast("long").alias("length"))

        return F.filter(F.zip_with(turns, ends, span), lambda s: s["start"].isNotNull())

    return let(written_turns(formatted), spans)


def masked_text(formatted: Column, mask: Column) -> Column:
    """What the mask covers, unescaped, one after the other."""
    step = step_of(formatted)
    said = F.transform(mask, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), step))
    return F.array_join(said, "")


def format_chats(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``conversation``, ``formatted``, ``turns`` (as read back from it) and ``mask`` of every conversation."""
    held = rows.select(
        F.col(conversation).alias("_conversation"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    grouped = held.groupBy("_conversation").agg(F.sort_array(F.collect_list("_turn")).alias("_sorted"))
    source = F.transform("_sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(_TURNS)
    tried = compute_once(grouped, ["_conversation"], {"_turns": source, "formatted": F.lit(None).cast("string")})
    for step in range(STEPS):
        # what came back identical stays; the rest is written with one more step of escapes
        tried = compute_once(tried, ["_conversation", "_turns"], {"formatted": F.coalesce("formatted", render(F.col("_turns"), step))})
        failed = ~parse(F.col("formatted")).eqNullSafe(F.col("_turns"))
        again = F.raise_error(F.lit("a conversation differs after it is read back")) if step == STEPS - 1 else F.lit(None)
        tried = compute_once(tried, ["_conversation", "_turns"], {"formatted": F.when(failed, again.cast("string")).otherwise(F.col("formatted"))})
    return tried.select(
        F.col("_conversation").alias(conversation),
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        loss_mask(F.col("formatted")).alias("mask"),
    )
