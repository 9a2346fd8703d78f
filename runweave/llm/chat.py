"""Chat formatting: roles of transcript turns by a hidden Markov model, then canonical rendering.

A text is cut at lines that begin with a speaker marker. Each piece gives categorical features (its marker and traits
of its lines). Emission and transition counts come from all pieces of known role; Viterbi then recovers the roles of a
conversation. A conversation may be of any length: its pieces lie in blocks of turns, a first pass gives the best
scores from every state before a block to every state at its end, a second one joins the blocks of a conversation,
and a third runs through each block between the states found for its ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, no_clash

ROLES = ("system", "user", "assistant")
#: Words of speaker markers and the roles that they hint at (fixed values).
SPEAKERS = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a")}
#: Turns that share a block; smoothing of counts.
TURNS_A_BLOCK, SMOOTH = 256, 0.5
_WORDS = "|".join(w for words in SPEAKERS.values() for w in words)
MARKER = rf"(?:#{{1,6}} *|\*\*|\[|<\|)?(?:{_WORDS})(?:(?:\*\*|\]|\|>)? *:(?:\*\*)?|\]|\|>)"
FORM = ("<|", "|>\n", "\n<|end|>\n")


def pieces(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role") -> DataFrame:
    """conv, turn, piece int, marker, content string, role (null where not one of ROLES), f array<string>, block long.

    A text is cut before each line with a speaker marker; a text without gives one piece, null counts as empty. Rows
    without a turn or without a conversation have no order: each is a conversation of its own, at turn 0, so that no
    block holds them all, however many they are. conv is a key: see conversation().
    """
    cut_at = F.split(F.coalesce(text_col, F.lit("")), rf"(?i)\n(?=[ \t]*{MARKER})")
    role = F.lower(F.trim(role_col)) if role_col else F.lit(None).cast("string")
    loose = F.col(conv_col).isNull() | F.col(turn_col).isNull()
    tag = F.when(loose, F.concat(F.monotonically_increasing_id().cast("string"), F.when(F.col(conv_col).isNull(), "n").otherwise(""))).otherwise("")
    rows = df.select(F.concat(tag, F.lit(":"), F.coalesce(F.col(conv_col).cast("string"), F.lit(""))).alias("conv"), F.when(loose, 0).otherwise(F.col(turn_col).cast("long")).alias("turn"), F.when(role.isin(*ROLES), role).alias("role"), cut_at.alias("cut_at"))
    rows = rows.select("conv", "turn", "role", F.posexplode("cut_at").alias("piece", "raw"))
    word = F.lower(F.regexp_extract("raw", rf"(?i)^\s*(?:#{{1,6}} *|\*\*|\[|<\|)?({_WORDS})(?:(?:\*\*|\]|\|>)? *:(?:\*\*)?|\]|\|>)", 1))
    hint = F.lit("")
    for role_name, words in SPEAKERS.items():
        hint = F.when(word.isin(*words), role_name).otherwise(hint)
    rows = rows.withColumn("marker", hint).withColumn("content", F.trim(F.regexp_replace("raw", rf"(?i)^\s*{MARKER}[ \t]*", "")))
    return rows.select("conv", "turn", "piece", "marker", "content", "role", features(F.col("marker"), F.col("content")).alias("f"), F.floor(F.col("turn") / TURNS_A_BLOCK).cast("long").alias("block"))


def conversation(key: Column) -> Column:
    """The conversation, as a string, of a key of pieces(): what follows the colon, null for a key of 'n'."""
    at = F.locate(":", key)
    return F.when(F.substring(key, at - 1, F.lit(1)) == "n", F.lit(None)).otherwise(F.substring(key, at + 1, F.length(key)))


def features(marker: Column, content: Column) -> Column:
    """Categorical traits of a piece, each as 'name=value'."""
    bucket = lambda n: F.floor(F.log2(n.cast("double") + 1) * 2).cast("string")
    named = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    return F.array(
        named("marker", marker),
        named("chars", bucket(F.length(content))),
        named("lines", F.least(F.regexp_count(content, F.lit("\n")), F.lit(6))),
        named("asks", F.least(F.regexp_count(content, F.lit(r"\?")), F.lit(2))),
        named("ends", F.when(content.endswith("?"), "?").when(content.endswith("."), ".").otherwise("-")),
        named("marks", F.least(F.regexp_count(content, F.lit(r"(?m)^\s*(?:[-*]|\d+\.|```)")), F.lit(3))),
        named("opens", F.when(content.rlike(r"(?i)^you (?:are|must|will)\b"), "order").when(content.rlike(r"(?i)^(?:how|what|why|who|when|where|can|could|please)\b"), "ask").otherwise("-")),
    )


def _dealt(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("conv", "block").sortWithinPartitions("conv", "block", *more)


def model(rows: DataFrame) -> dict:
    """{"emit": {feature: scores by role}, "unseen": scores, "move": scores [before or start][role]} from known roles.

    Scores are logarithms. Emissions count all pieces of known role, transitions all neighbouring ones inside a block
    (of first blocks also the first piece). Only the counts, a few dozen rows, come to the driver.
    """
    from math import log

    emit = rows.where("role is not null").select("role", F.explode("f").alias("name")).groupBy("role", "name").count().collect()
    moves = _dealt(rows.select("conv", "block", "turn", "piece", "content", "role"), "turn", "piece", "content").mapInPandas(_moves, "before string, role string, n long").groupBy("before", "role").agg(F.sum("n").alias("n")).collect()
    kinds: dict[str, set[str]] = {}
    counts: dict[tuple[str, str], int] = {}
    for row in emit:
        kinds.setdefault(row["name"].split("=")[0], set()).add(row["name"])
        counts[row["role"], row["name"]] = row["count"]
    known = {r: sum(n for (role, name), n in counts.items() if role == r and name.startswith("marker=")) for r in ROLES}
    scores = {name: [log((counts.get((r, name), 0) + SMOOTH) / (known[r] + SMOOTH * (len(names) + 1))) for r in ROLES] for names in kinds.values() for name in names}
    for r, role in enumerate(ROLES):  # a marker speaks for its role even if no known piece has one
        name = f"marker={role}"
        if name not in scores:
            scores[name] = [0.0 if i == r else -6.0 for i in range(len(ROLES))]
    seen = {(row["before"], row["role"]): row["n"] for row in moves}
    move = []
    for before in (*ROLES, "start"):
        total = sum(seen.get((before, r), 0) for r in ROLES)
        move.append([log((seen.get((before, r), 0) + SMOOTH) / (total + SMOOTH * len(ROLES))) for r in ROLES])
    return {"emit": scores, "move": move}


def _moves(frames: Iterable) -> Iterator:
    import pandas as pd

    held, counts = None, {}
    for frame in frames:
        for conv, block, role in zip(frame["conv"], frame["block"], frame["role"], strict=True):
            key = (None if pd.isna(conv) else conv, block)
            before = held[1] if held and held[0] == key else "start" if block == 0 else None
            if before and role:
                counts[before, role] = counts.get((before, role), 0) + 1
            held = (key, role)
    yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["before", "role", "n"])


def recover(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role", learn: Column | None = None) -> DataFrame:
    """conv_col, turn_col, piece, role, marker, content, rendered of each piece: the transcript in canonical turns.

    role is the one that Viterbi recovers from markers, line features and order; given roles only serve to learn the
    model, those of rows where `learn` holds (default: all). Order within a conversation: turn, piece, then content, so
    equal (conv, turn) rows have a defined place. A row without a conversation or without a turn is a conversation of
    its own; its turn comes out as 0. rendered is '<|role|>', the content and '<|end|>' on lines of their own. Repeated
    rows stay. Further columns of df, whatever their names, do not matter; conv_col or turn_col by the name of an output
    is an error (ValueError).
    """
    no_clash([conv_col, turn_col], "piece", "role", "marker", "content", "rendered")
    shown = df if learn is None or role_col is None else df.withColumn(role_col, F.when(learn, F.col(role_col)))
    rows = cut(pieces(shown, conv_col, turn_col, text_col, role_col))
    shared = df.sparkSession.sparkContext.broadcast(model(rows))
    stream = rows.select("conv", "block", "turn", "piece", "content", "f", "marker", F.lit(None).cast("int").alias("enter"), F.lit(None).cast("int").alias("leave"), F.lit(1).alias("kind"))
    kind = rows.schema["conv"].dataType.simpleString()
    table = _dealt(stream.select("conv", "block", "turn", "piece", "content", "f"), "turn", "piece", "content").mapInPandas(lambda frames: _transfers(frames, shared.value), f"conv {kind}, block long, best array<double>")
    ends = cut(cut(table).repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(_joined, f"conv {kind}, block long, enter int, leave int"))
    heads = ends.select("conv", "block", F.lit(0).cast("long").alias("turn"), F.lit(0).alias("piece"), F.lit("").alias("content"), F.array().cast("array<string>").alias("f"), F.lit("").alias("marker"), "enter", "leave", F.lit(0).alias("kind"))
    found = _dealt(heads.unionByName(stream), "kind", "turn", "piece", "content").mapInPandas(lambda frames: _paths(frames, shared.value), f"conv {kind}, turn long, piece int, role string, marker string, content string")
    head, middle, end = FORM
    return found.select(conversation(F.col("conv")).cast(df.schema[conv_col].dataType).alias(conv_col), F.col("turn").alias(turn_col), "piece", "role", "marker", "content", F.concat(F.lit(head), "role", F.lit(middle), "content", F.lit(end)).alias("rendered"))


def _emissions(model: dict, features: Iterable[str]):
    import numpy as np

    total = np.zeros(len(ROLES))
    for name in features:
        if name in model["emit"]:
            total += model["emit"][name]
    return total


def _key(conv, block):
    return (None if conv != conv or conv is None else conv, block)


def _transfers(frames: Iterable, model: dict) -> Iterator:
    """For each block the best score from each state before it (the start last) to each state at its end."""
    import numpy as np
    import pandas as pd

    move, held, best = np.array(model["move"]), None, None
    for frame in frames:
        out = []
        for conv, block, f in zip(frame["conv"], frame["block"], frame["f"], strict=True):
            e = _emissions(model, f)
            if held != (key := _key(conv, block)):
                if held is not None:
                    out.append((*held, best.ravel().tolist()))
                held, best = key, move + e
            else:
                best = (best[:, :, None] + move[None, : len(ROLES), :]).max(axis=1) + e
        yield pd.DataFrame(out, columns=["conv", "block", "best"])
    if held is not None:
        yield pd.DataFrame([(*held, best.ravel().tolist())], columns=["conv", "block", "best"])


def _joined(frames: Iterable) -> Iterator:
    """States before and at the end of each block of a conversation, from its blocks' transfers; -1 stands for start."""
    import numpy as np
    import pandas as pd

    def solve(conv, blocks: list) -> list[tuple]:
        n, score, back = len(ROLES), None, []
        for _, best in blocks:
            if score is None:
                score, origin = best[n], [-1] * n
            else:
                through = score[:, None] + best[:n]
                origin, score = through.argmax(axis=0).tolist(), through.max(axis=0)
            back.append(origin)
        state, out = int(np.argmax(score)), []
        for (block, _), origin in zip(reversed(blocks), reversed(back), strict=True):
            out.append((conv, block, origin[state], state))
            state = origin[state]
        return out

    held, blocks, missing = None, [], object()
    last = missing
    for frame in frames:
        out: list[tuple] = []
        for conv, block, best in zip(frame["conv"], frame["block"], frame["best"], strict=True):
            conv = _key(conv, 0)[0]
            if last is not missing and conv != held:
                out += solve(held, blocks)
                blocks = []
            held = last = conv
            blocks.append((block, np.asarray(best, dtype=np.float64).reshape(len(ROLES) + 1, len(ROLES))))
        yield pd.DataFrame(out, columns=["conv", "block", "enter", "leave"])
    if blocks:
        yield pd.DataFrame(solve(held, blocks), columns=["conv", "block", "enter", "leave"])


def _paths(frames: Iterable, model: dict) -> Iterator:
    """The best path through each block between its given ends; the first row of a block carries them."""
    import numpy as np
    import pandas as pd

    move, n = np.array(model["move"]), len(ROLES)
    names = ["conv", "turn", "piece", "role", "marker", "content"]

    def solve(ends: tuple, rows: list) -> list[tuple]:
        score, back = None, []
        for row in rows:
            e = row[-1]
            if score is None:
                score = move[ends[0] if ends[0] >= 0 else n] + e
            else:
                through = score[:, None] + move[:n]
                back.append(through.argmax(axis=0))
                score = through.max(axis=0) + e
        state, states = ends[1], []
        for origin in reversed(back):
            states.append(state)
            state = int(origin[state])
        states.append(state)
        return [(r[0], r[1], r[2], ROLES[s], r[3], r[4]) for r, s in zip(rows, reversed(states), strict=True)]

    ends, rows = None, []
    for frame in frames:
        out: list[tuple] = []
        for x in frame.itertuples(index=False):
            if x.kind == 0:
                if rows:
                    out += solve(ends, rows)
                ends, rows = (int(x.enter), int(x.leave)), []
            else:
                rows.append((_key(x.conv, 0)[0], x.turn, x.piece, x.marker, x.content, _emissions(model, x.f)))
        yield pd.DataFrame(out, columns=names)
    if rows:
        yield pd.DataFrame(solve(ends, rows), columns=names)
