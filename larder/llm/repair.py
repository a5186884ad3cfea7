"""Conversation structure repair: the cheapest edits that make turns alternate, by a rank-compressed dynamic programme."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, table

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What the output ends with so far: nothing, the system turn, a user turn or an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A macro is a run of insertions and one edit of a turn. No code begins another, so two sequences of as many macros
#: compare as their first different codes do. A longer run is never cheapest: two more insertions lead back to where they began, or to what fewer edits reach.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
_ORDER = {c: i for i, c in enumerate(CODES)}
_AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an insertion or another role leads to
_KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
_CLOSE = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # insertions that end an output properly


def _macros(kind: str, state: int) -> list[tuple]:
    """(rank of the code, cost, next state, turns put out) of the macros for a turn of this kind: s, u, a, o for others, in capitals if truncated, - for one that must go."""
    out, cost, made = [], 0, ""
    for run in ("", "I", "II"):
        out.append((_ORDER[run + "D"], cost + DELETE, state, made))
        if kind != "-":
            more = TRUNCATED if kind.isupper() else 0
            keep, role = _KEEPS[kind.lower()].get(state), _AFTER[state]
            if keep is not None:
                out.append((_ORDER[run + "K"], cost + more, keep, made + "K"))
            out.append((_ORDER[run + "R"], cost + more + REROLE, role, made + ("U" if role == USER else "A")))
        state = _AFTER[state]
        cost, made = cost + INSERT, made + ("u" if state == USER else "a")
    return out


_TABLE = {kind: [_macros(kind, s) for s in range(4)] for kind in "suaoSUAO-"}


def parse(steps: str) -> list[tuple[str, int]]:
    """Steps of a block written as ``u0 a2 -3``: a turn, and how many copies after it must go. Copies that must go make one step."""
    out = []
    for step in steps.split():
        kind, copies = step[0], int(step[1:])
        if kind != "-":
            out.append((kind, 1))
        if copies:
            out.append(("-", copies))
    return out


def layers(steps: list[tuple[str, int]], entry: int) -> list[dict[int, tuple]]:
    """For each step, the best way into each state from ``entry``: (cost, rank, state before, macro).

    Ways into a state compare by cost and then by the text of their edits. That text is never held: the rank of the state before
    stands for all of it but the last code, and each layer is ranked anew, so a layer has at most four entries.
    """
    made = [{entry: (0, 0, -1, None)}]
    for kind, copies in steps:
        best: dict[int, tuple] = {}
        for state, (cost, rank, *_) in made[-1].items():
            for macro in _TABLE[kind][state]:
                key = (cost + macro[1] + (copies - 1) * DELETE, rank, macro[0])
                if macro[2] not in best or key < best[macro[2]][0]:
                    best[macro[2]] = (key, state, macro)
        order = {s: i for i, (_, s) in enumerate(sorted((b[0][1:], s) for s, b in best.items()))}
        made.append({s: (key[0], order[s], state, macro) for s, (key, state, macro) in best.items()})
    return made


def summary(steps: str, first: bool) -> tuple[list[int], list[int]]:
    """Cost and rank of the best way from each state at the begin of a block to each at its end, -1 where there is none; the first block of a conversation begins with nothing."""
    costs, ranks = [-1] * 16, [0] * 16
    for entry in (START,) if first else range(4):
        for state, (cost, rank, *_) in layers(parse(steps), entry)[-1].items():
            costs[4 * entry + state], ranks[4 * entry + state] = cost, rank
    return costs, ranks


def fold(costs, ranks) -> tuple[int, int, list[int]]:
    """Cost of a conversation, insertions at its end, and the states at the ends of its blocks, from the blocks' summaries in order."""
    made = [{START: (0, 0, -1)}]
    for c, r in zip(costs, ranks):
        best: dict[int, tuple] = {}
        for entry, (cost, rank, _) in made[-1].items():
            for state in range(4):
                if c[4 * entry + state] >= 0:
                    key = (cost + int(c[4 * entry + state]), rank, int(r[4 * entry + state]))
                    if state not in best or key < best[state][0]:
                        best[state] = (key, entry)
        order = {s: i for i, (_, s) in enumerate(sorted((b[0][1:], s) for s, b in best.items()))}
        made.append({s: (key[0], order[s], entry) for s, (key, entry) in best.items()})
    cost, _, state = min((cost + INSERT * _CLOSE[s], rank, s) for s, (cost, rank, _) in made[-1].items())
    tail, states = _CLOSE[state], []
    for layer in reversed(made):
        states.append(state)
        state = layer[state][2]
    return cost, tail, states[::-1]


def trace(steps: str, entry: int, leave: int) -> list[dict[str, str]]:
    """Edits of each turn of a block and the turns they put out (K kept, U and A with another role, u and a put in), by the states at its begin and end."""
    todo, state, out = parse(steps), int(leave), []
    for (_, copies), layer in zip(reversed(todo), reversed(layers(todo, int(entry)))):
        _, _, before, macro = layer[state]
        out.append((CODES[macro[0]] + "D" * (copies - 1), macro[3]))
        state = before
    parts, rows = iter(reversed(out)), []
    for step in steps.split():
        got = [next(parts) for _ in range((step[0] != "-") + (int(step[1:]) > 0))]
        rows.append({"edits": "".join(e for e, _ in got), "made": "".join(m for _, m in got)})
    return rows


def _summaries(steps: pd.Series, first: pd.Series) -> pd.DataFrame:
    memo = {key: summary(*key) for key in set(zip(steps, first))}  # common conversations once a batch
    return pd.DataFrame([memo[key] for key in zip(steps, first)], columns=["costs", "ranks"])


def _folds(costs: pd.Series, ranks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fold(c, r) for c, r in zip(costs, ranks)], columns=["cost", "tail", "states"])


def _traces(steps: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
    memo = {key: trace(*key) for key in set(zip(steps, entry, leave))}
    return pd.Series([memo[key] for key in zip(steps, entry, leave)], dtype=object)


def _bad(pair: Column) -> Column:
    return ~pair.isin("su", "ua", "au")


def _illegal(initials: Column) -> Column:
    """Neighbours in an array of initials that may not follow each other."""
    n = F.size(initials) - 1
    pairs = F.when(n > 0, F.zip_with(F.slice(initials, 1, n), F.slice(initials, 2, n), lambda x, y: F.concat(x, y)))
    return F.coalesce(F.size(F.filter(pairs, _bad)), F.lit(0)).cast("long")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """(conv, block, rows, ...): the rows of each conversation in blocks of ``block`` turns, equal rows as one with their count, and what a report needs of them."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv", "turn", role.alias("role"), text.alias("text"), F.col("n").cast("long").alias("n"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    said = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("-")), F.length("role"), "role", "text")
    rows = rows.withColumn("said", F.unhex(F.md5(said.cast("binary")))).withColumn("at", F.struct(F.col("turn").isNotNull().alias("has"), "turn"))
    # A frequent saying meets its first turn after a sum at each task; the join is inner, so that Spark can split a hot one.
    rows = rows.join(rows.groupBy("said").agg(F.min(F.when(F.col("n") > 0, F.col("at"))).alias("begun")), "said")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank, again = end == "", ~F.col("at").eqNullSafe(F.col("begun"))
    kind = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    cut_off = ~F.substring(end, -1, 1).isin(".", "!", "?")
    step = F.when(blank | again, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.concat(F.when(cut_off, F.upper(kind)).otherwise(kind), (F.col("n") - 1).cast("string")))
    r = F.struct("turn", "role", "text", "n", step.alias("step"))
    there = F.col("n") > 0
    kept = lambda c: F.when(there, c)
    total = lambda c, name: F.coalesce(F.sum(kept(c)), F.lit(0)).cast("long").alias(name)
    b = rows.groupBy("conv", F.floor(F.col("turn") / block).alias("block")).agg(
        F.array_sort(F.collect_list(kept(r))).alias("rows"), F.min(kept(F.col("turn"))).alias("low"), F.max(kept(F.col("turn"))).alias("high"), F.count_distinct(kept(F.col("turn"))).alias("turns"),
        total(F.when(blank, F.col("n")).otherwise(0), "blank"), total(F.when(blank, 0).when(again, F.col("n")).otherwise(F.col("n") - 1), "duplicate"),
        total(F.when(~blank & ~again & cut_off, 1).otherwise(0), "truncated"), total(F.col("n") - 1, "copies"),
    )
    b = b.withColumn("initials", F.transform("rows", lambda x: F.substring(x["role"], 1, 1))).withColumn("steps", F.array_join(F.transform("rows", lambda x: x["step"]), " "))
    return b.withColumn("illegal", _illegal(F.col("initials")) + F.col("copies"))


def repair(turns: DataFrame, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of conversations: rows (conv, turn, role, text, n), ``n`` times each one after the other.

    Rows stand by turn, nulls first, then role and text. The first fault of a row counts: blank (nothing but blanks), duplicate (role and text stood before in the conversation) or
    truncated (its last character that is no blank is none of ``.!?``). Kept turns must read: at most one system turn, then user and assistant in turn, at least once; or nothing at all. Edits
    are K (free), R (another role, user or assistant), D (must for blank and duplicate rows) and I (an empty turn put in), and
    a truncated row that stays costs more. The cheapest edits win, of these the least as a text.

    ``report`` has a row for each conversation, also where all its rows have n = 0: gaps (turns missing between the least and the greatest), blank, duplicate, truncated, illegal (neighbours that may not follow each other), cost, audit (the edits).
    ``repaired`` has a row for each turn that comes out: conv, block, place, role, text; their order is that of block (null first) and place.

    A conversation is cut into blocks of ``block`` turns, which are solved apart for each state they may begin in; a fold over the blocks' sixteen costs
    and ranks picks the states between them, and each block then writes its edits. So no task holds a whole conversation, however long, until its
    audit is put together. Equal rows are one row with a count from the first shuffle on. Null roles and texts count as one blank; a null conversation is one of its own.
    A text of any length stays one value of its block. An empty table gives no rows. Other columns are not read, so none can clash.
    """
    blocks = cut(_blocks(turns, block))
    solved = F.pandas_udf(_summaries, "costs array<long>, ranks array<long>")(F.col("steps"), F.col("first"))
    begun = blocks.groupBy(F.col("conv").alias("_conv")).agg(F.min(F.struct(F.col("block").isNotNull().alias("has"), "block")).alias("_first"))
    sums = blocks.drop("rows").join(begun, F.col("conv").eqNullSafe(F.col("_conv")))
    sums = sums.withColumn("first", F.col("_first.block").eqNullSafe(F.col("block"))).withColumn("s", solved)
    whole = sums.select("conv", "block", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "s", F.struct(F.get("initials", F.lit(0)).alias("a"), F.element_at(F.when(F.size("initials") > 0, F.col("initials")), -1).alias("b")).alias("ends"))
    one = F.struct("block", "s", "ends")
    add = lambda c: F.sum(c).alias(c)
    whole = whole.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), *map(add, ("turns", "blank", "duplicate", "truncated", "illegal")))
    folded = F.pandas_udf(_folds, "cost long, tail int, states array<int>")(F.transform("parts", lambda p: p["s"]["costs"]), F.transform("parts", lambda p: p["s"]["ranks"]))
    ends = F.filter(F.transform("parts", lambda p: p["ends"]), lambda e: e["a"].isNotNull())
    between = F.zip_with(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))), lambda x, y: F.concat(x["b"], y["a"]))
    whole = cut(whole.withColumn("f", folded).withColumn("illegal", F.col("illegal") + F.when(F.size(ends) > 1, F.size(F.filter(between, _bad))).otherwise(0)))
    path = whole.select(F.col("conv").alias("_conv"), F.posexplode("parts").alias("i", "p"), "f.states").select("_conv", F.col("p.block").alias("_block"), F.get("states", F.col("i")).alias("entry"), F.get("states", F.col("i") + 1).alias("leave"))
    done = blocks.select("conv", "block", "rows", "steps").join(path, F.col("conv").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
    edits = F.pandas_udf(_traces, "array<struct<edits:string,made:string>>")("steps", "entry", "leave")
    done = cut(done.select("conv", "block", "rows", edits.alias("edits")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    pieces = done.select(F.col("conv").alias("_conv"), F.struct("block", F.array_join(F.transform("edits", lambda e: e["edits"]), "").alias("audit")).alias("piece")).groupBy("_conv").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    audit = F.concat(F.array_join(F.transform("pieces", lambda p: p["audit"]), ""), F.repeat(F.lit("I"), F.col("f.tail")))
    report = whole.join(pieces, F.col("conv").eqNullSafe(F.col("_conv")))
    report = report.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("f.cost").alias("cost"), audit.alias("audit"))

    def line(x: Column, m: Column) -> Column:
        role = F.when(m == "K", x["role"]).when(F.lower(m) == "u", "user").otherwise("assistant")
        return F.struct(role.alias("role"), F.when(m.isin("u", "a"), "").otherwise(x["text"]).alias("text"))

    lines = F.flatten(F.zip_with("rows", "edits", lambda x, e: F.transform(F.filter(F.split(e["made"], ""), lambda m: m != ""), lambda m: line(x, m))))
    inside = done.select("conv", "block", F.posexplode(lines).alias("place", "l")).select("conv", "block", "place", "l.*")
    last = whole.where("f.tail > 0").select("conv", F.lit(2**62).alias("block"), F.posexplode(F.slice(F.array(F.lit("user"), F.lit("assistant")), 3 - F.col("f.tail"), F.col("f.tail"))).alias("place", "role"))
    return report, inside.unionByName(last.withColumn("text", F.lit("")))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """``conversations`` damaged by the contract's rule, then repaired."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("n"),
    )
    report, repaired = repair(turns)
    # The digest is of a whole conversation's text.
    lines = repaired.groupBy(F.col("conv").alias("_conv")).agg(F.array_sort(F.collect_list(F.struct("block", "place", F.concat_ws(":", "role", "text").alias("line")))).alias("lines"))
    whole = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(""))
    out = report.join(lines, F.col("conv").eqNullSafe(F.col("_conv")), "left").withColumn("repaired_sha256", F.sha2(whole.cast("binary"), 256))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
