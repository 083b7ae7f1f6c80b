"""Cheapest repairs of conversations, found by a Viterbi search over chunks of turns in parallel.

A conversation should read: a system turn or none, then user and assistant in turn, ending with the assistant (or nothing at all). Turns
are kept, given the other role, deleted or inserted. The search runs backwards over four states. A long conversation is cut into chunks
that start from a speculative vector of costs; fix-up passes run a chunk again from its neighbour's vector, only until its vectors differ from the ones
it had by a constant. Backward costs alone decide each edit, so the tracing of chunks needs nothing but the state each one is entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scans import null_safe_join
from wardlight.llm.blocks import write_table

START, SYSTEM, USER, ASSISTANT = range(4)  # what was the last turn
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)  # the one role that an inserted or changed turn can have
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
FINE, TRUNCATED, GONE = range(3)
LEGAL = frozenset(["su", "ua", "au"])
END = (0, 6, 3, 0)  # costs behind the last turn: insertions until the conversation may end
BLANKS = " \t\n\x0b\x0c\r"

CHUNK_ROWS = 256
CHUNK_CHARS = 1_000_000
PASSES = 3  # fix-up passes from neighbour to neighbour; chunks that are still open take their vector through products
FAR = 1 << 40  # more than any cost


def code_of(role: str, fault: int) -> int:
    return ("sua".find(role[0]) + 1 if role else 0) + 4 * fault


def actions(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a turn, by letter; insertions stand before the turn and are not here."""
    fault, initial = code // 4, "?sua"[code % 4]
    yield "D", DELETE, state
    if fault != GONE:
        extra = CUT_SHORT if fault == TRUNCATED else 0
        if (state, initial) in KEEP:
            yield "K", extra, KEEP[state, initial]
        yield "R", REROLE + extra, NEXT[state]


def step(after: tuple, code: int) -> tuple:
    """Least costs before a turn from those behind it, insertions before it included."""
    own = [min(cost + after[to] for _, cost, to in actions(code, s)) for s in range(4)]
    pair = (min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER]))
    return (min(own[START], INSERT + pair[0]), min(own[SYSTEM], INSERT + pair[0]), *pair)


class Search:
    """The backward search with what it has met: few vectors occur once their least cost is taken off."""

    def __init__(self) -> None:
        self.steps: dict = {}
        self.letters: dict = {}

    def before(self, after: tuple, code: int) -> tuple[tuple, int]:
        """The vector before a turn less its least cost, and that cost."""
        got = self.steps.get((after, code))
        if got is None:
            costs = step(after, code)
            got = self.steps[after, code] = tuple(c - min(costs) for c in costs), min(costs)
        return got

    def run(self, codes: bytes, end: tuple, old: list[tuple] | None = None) -> list[tuple]:
        """Vectors at all bounds of a chunk. ``old``: those of an earlier pass; where the new one meets them, the rest is known."""
        at = [end] * (len(codes) + 1)
        for i in range(len(codes) - 1, -1, -1):
            at[i] = self.before(at[i + 1], codes[i])[0]
            if old and at[i] == old[i]:
                at[:i] = old[:i]
                break
        return at

    def cost(self, codes: bytes, at: list[tuple]) -> int:
        """What the vectors before the chunk lack against those behind it."""
        return sum(self.before(at[i + 1], c)[1] for i, c in enumerate(codes))

    def edit(self, after: tuple, code: int, state: int) -> tuple[str, int]:
        """The letters up to and with a turn, the least in ASCII among the cheapest, and the state behind it."""
        got = self.letters.get((after, code, state))
        if got is None:
            costs, here, word = step(after, code), state, ""
            while True:
                best = {letter: to for letter, cost, to in actions(code, here) if cost + after[to] == costs[here]}
                if "D" not in best and INSERT + costs[NEXT[here]] == costs[here]:
                    word, here = word + "I", NEXT[here]
                    continue
                letter = min(best)
                break
            got = self.letters[after, code, state] = word + letter, best[letter]
        return got

    def leave(self, codes: bytes, at: list[tuple], state: int) -> int:
        for i, c in enumerate(codes):
            state = self.edit(at[i + 1], c, state)[1]
        return state


def closing(state: int) -> str:
    return "I" * (END[state] // INSERT)


def product(codes: bytes) -> list[int]:
    """The chunk as a matrix, row by row: least cost from each state before it to each state behind it."""
    columns = []
    for j in range(4):
        vector = tuple(0 if s == j else FAR for s in range(4))
        for c in reversed(codes):
            vector = tuple(min(x, FAR) for x in step(vector, c))
        columns.append(vector)
    return [columns[j][s] for s in range(4) for j in range(4)]


def to_bytes(at: list[tuple]) -> bytes:
    return bytes(x for v in at for x in v)


def to_vectors(raw: bytes) -> list[tuple]:
    return [tuple(raw[i:i + 4]) for i in range(0, len(raw), 4)]


# Chunks

FIELDS = (
    "number long, opens boolean, closes boolean, follows boolean, goes_on boolean, first_role string, last_role string, first_turn long, last_turn long, low_turn long, "
    "blank long, duplicate long, truncated long, illegal long, turns long, codes binary, copies array<long>, roles array<string>, texts array<string>"
)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, again): equal rows as one, and whether role and text stood in an earlier turn."""
    some = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *some).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = write_table(rows.withColumn("said", F.md5(F.col("text").cast("binary"))), "turns")
    when = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = rows.groupBy("conv_id", "role", "said").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return null_safe_join(rows, first, ["conv_id", "role", "said"], "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce(when > F.col("first"), F.lit(False)).alias("again"))


def cut_chunks(rows: DataFrame, chunk_rows: int, chunk_chars: int) -> DataFrame:
    """Chunks of at most ``chunk_rows`` turns of one conversation. The turns are dealt to ranges of (conv_id, turn, role, text) and
    sorted there, so that a conversation of any length is spread; what a chunk has to know of its neighbours in the range is noted."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[f.split()[0] for f in FIELDS.split(", ")]]

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        held, before, pending = None, None, None

        def batch_of(chunk):
            return pa.RecordBatch.from_pydict({c: pa.array([chunk[c]], t) for c, t in zip(names, types, strict=True)})

        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field("conv_id").type, pa.int64(), *[pa.bool_()] * 4, pa.string(), pa.string(), *[pa.int64()] * 8, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            for conv, turn, role, text, copies, again in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                same = held is not None and held["conv_id"] == conv
                if held is None or not same or len(held["roles"]) >= chunk_rows or held["chars"] >= chunk_chars:
                    if held is not None:
                        held["goes_on"] = same
                        held["codes"] = bytes(held["codes"])
                        if pending is not None:
                            yield batch_of(pending)
                        pending = held
                    held = dict.fromkeys(names, 0) | {
                        "conv_id": conv, "number": number, "opens": pending is None, "closes": False, "follows": same, "goes_on": False, "first_role": role[:1], "first_turn": turn, "low_turn": None, "codes": bytearray(), "copies": [], "roles": [], "texts": [], "chars": 0,
                    }
                    number += 1
                bare = text.rstrip(BLANKS)
                fault = GONE if not bare or again else FINE if bare[-1] in ".!?" else TRUNCATED
                held["blank" if not bare else "duplicate" if again else "truncated"] += fault != FINE
                held["blank" if not bare else "duplicate"] += copies - 1
                held["illegal"] += (same and before[0] + role[:1] not in LEGAL) + copies - 1
                held["turns"] += turn is not None and not (same and before[1] == turn)
                held["codes"].append(code_of(role, fault))
                held["copies"].append(copies)
                held["roles"].append(role)
                held["texts"].append(text)
                held["chars"] += len(text)
                held["low_turn"] = turn if held["low_turn"] is None else held["low_turn"]
                held["last_role"], held["last_turn"] = before = role[:1], turn
        if pending is not None:
            yield batch_of(pending)
        if held is not None:
            yield batch_of(held | {"closes": True, "codes": bytes(held["codes"])})

    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(dealt.mapInArrow(run, f"conv_id {kind}, {FIELDS}"), "turn-chunks")


def linked(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the numbers of the chunks before and behind in the conversation (null: none); counts at the bounds of ranges put right.

    The first and last chunks of the ranges, two rows for each of Spark's partitions, come to the driver without their turns.
    """
    edges = chunks.where("opens or closes").select("conv_id", "number", "opens", "closes", "first_role", "last_role", "first_turn", "last_turn").orderBy("number").collect()
    more: dict[int, list] = {}
    for a, b in zip(edges, edges[1:], strict=False):
        if a["closes"] and b["opens"] and a["conv_id"] == b["conv_id"]:
            more.setdefault(a["number"], [None, None, 0, 0])[1] = b["number"]
            again = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
            more.setdefault(b["number"], [None, None, 0, 0])[:1] = [a["number"]]
            more[b["number"]][2:] = [int(a["last_role"] + b["first_role"] not in LEGAL), int(again)]
    table = chunks.sparkSession.createDataFrame([(k, *v) for k, v in more.items()], "number long, edge_prev long, edge_next long, more_illegal long, fewer_turns long")
    rows = chunks.join(F.broadcast(table), "number", "left")
    return rows.select(
        *[c for c in chunks.columns if c not in ("illegal", "turns")],
        (F.col("illegal") + F.coalesce("more_illegal", F.lit(0))).alias("illegal"), (F.col("turns") - F.coalesce("fewer_turns", F.lit(0))).alias("turns"),
        F.when(F.col("follows"), F.col("number") - 1).otherwise(F.col("edge_prev")).alias("prev"), F.when(F.col("goes_on"), F.col("number") + 1).otherwise(F.col("edge_next")).alias("next"),
    )


# Fix-up passes

def searched(rows: DataFrame) -> DataFrame:
    """(number, prev, next, codes, path): a run of each row (number, prev, next, codes, end, path) from ``end``; ``path`` of an earlier pass or null."""
    def run(batches):
        search = Search()
        for batch in batches:
            out = []
            for codes, end, path in zip(*[batch.column(c).to_pylist() for c in ("codes", "end", "path")], strict=True):
                out.append(to_bytes(search.run(codes, tuple(end), to_vectors(path) if path else None)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("number", "prev", "next", "codes")], pa.array(out, pa.binary())], ["number", "prev", "next", "codes", "path"])

    kept = rows.select("number", "prev", "next", "codes", F.col("end").cast("binary").alias("end"), "path")
    return kept.mapInArrow(run, "number long, prev long, next long, codes binary, path binary")


def _bytes_at(column: str, start: int) -> Column:
    return F.expr(f"substring({column}, {start}, 4)")


def doubled(links: DataFrame, combine, open_: Column) -> DataFrame:
    """(number, link, value) with every chain followed to its end: a row takes what its link has come to, so the rounds are the logarithm of the chain.

    ``open_``: rows that still need their link.
    """
    done, rows = None, write_table(links, "chain")
    while True:
        closed = rows.where(~open_)
        done = closed if done is None else done.unionByName(closed)
        left = rows.where(open_)
        if left.isEmpty():
            return done
        every = done.unionByName(left).select(F.col("number").alias("link"), F.col("link").alias("further"), F.col("value").alias("other"))
        rows = write_table(left.join(every, "link").select("number", F.col("further").alias("link"), combine(F.col("value"), F.col("other")).alias("value")), "chain")


def true_paths(chain: DataFrame) -> DataFrame:
    """(number, prev, next, codes, path) of chunks (number, prev, next, codes) of long conversations, each path up to a constant that of a search over the whole conversation."""
    end = F.lit(bytes(END))
    rows = write_table(searched(chain.select("*", end.alias("end"), F.lit(None).cast("binary").alias("path"))), "speculative")
    last = F.expr("substring(path, length(path) - 3, 4)")

    def wrong(rows: DataFrame) -> DataFrame:
        heads = rows.select(F.col("number").alias("next"), _bytes_at("path", 1).alias("head"))
        return rows.join(heads, "next", "left").withColumn("end", F.coalesce("head", end)).drop("head").withColumn("wrong", F.col("end") != last)

    for _ in range(PASSES):
        both = write_table(wrong(rows), "fix-up")
        if both.where("wrong").isEmpty():
            return rows
        rows = write_table(searched(both.where("wrong")).unionByName(both.where("not wrong").select(rows.columns)), "fixed")
    if wrong(rows).where("wrong").isEmpty():
        return rows

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([product(c.as_py()) for c in batch.column(2)], pa.list_(pa.int64()))], ["number", "link", "value"])

    def combine(a: Column, b: Column) -> Column:
        def cell(k: Column) -> Column:
            row, column = F.floor(k / 4).cast("int") * 4, k % 4
            return F.least(*[F.get(a, row + j) + F.get(b, column + 4 * j) for j in range(4)], F.lit(FAR))

        return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)

    matrices = chain.select("number", F.col("next").alias("link"), "codes").mapInArrow(run, "number long, link long, value array<long>")
    whole = doubled(matrices, combine, F.col("link").isNotNull())
    costs = F.array(*[F.least(*[F.get("value", F.lit(4 * s + j)) + END[j] for j in range(4)]) for s in range(4)])
    costs = F.transform(costs, lambda c: F.lpad(F.hex(c - F.array_min(costs)), 2, "0"))
    heads = whole.select(F.col("number").alias("next"), F.unhex(F.array_join(costs, "")).alias("head"))
    return write_table(searched(rows.join(heads, "next", "left").withColumn("end", F.coalesce("head", end))), "fixed")


def entered(paths: DataFrame) -> DataFrame:
    """(number, path, state): the state in which each chunk is entered."""
    def run(batches):
        search = Search()
        for batch in batches:
            maps = []
            for codes, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at = to_vectors(path)
                maps.append([search.leave(codes, at, s) for s in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.list_(pa.int32()))], ["number", "link", "value"])

    maps = paths.select("number", F.col("prev").alias("link"), "codes", "path").mapInArrow(run, "number long, link long, value array<int>")
    open_ = F.col("link").isNotNull() & (F.array_min("value") != F.array_max("value"))  # most chunks end alike, however they are entered
    left = doubled(maps, lambda a, b: F.transform(b, lambda s: F.get(a, s)), open_).select(F.col("number").alias("prev"), F.get("value", F.lit(START)).alias("state"))
    return paths.join(left, "prev", "left").select("number", "path", F.coalesce("state", F.lit(START)).alias("state"))


# Repairs

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def traced(chunks: DataFrame) -> DataFrame:
    """conv_id, number, counts, cost, audit, roles, texts: the edits of each chunk and the turns as they are afterwards."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    copied = ["conv_id", "number", *COUNTS, "low_turn", "last_turn"]

    def run(batches):
        search = Search()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                r = row.to_pylist()[0]
                codes, state = r["codes"], r["state"]
                at = to_vectors(r["path"]) if r["path"] else search.run(codes, END)
                cost = search.cost(codes, at) + (at[0][START] if r["prev"] is None else 0) + DELETE * (sum(r["copies"]) - len(codes))
                audit, roles, texts = [], [], []
                for k, c in enumerate(codes):
                    word, behind = search.edit(at[k + 1], c, state)
                    for letter in word:
                        if letter == "I":
                            state = NEXT[state]
                        if letter in "IR":
                            roles.append(ROLE[state if letter == "I" else behind])
                            texts.append("" if letter == "I" else r["texts"][k])
                        elif letter == "K":
                            roles.append(r["roles"][k])
                            texts.append(r["texts"][k])
                    audit.append(word + "D" * (r["copies"][k] - 1))
                    state = behind
                if r["next"] is None:
                    for _ in closing(state):
                        state = NEXT[state]
                        audit.append("I")
                        roles.append(ROLE[state])
                        texts.append("")
                own = {"cost": pa.array([cost], pa.int64()), "audit": pa.array(["".join(audit)]), "roles": pa.array([roles], pa.list_(pa.string())), "texts": pa.array([texts], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict({c: row.column(c) for c in copied} | own)

    schema = f"conv_id {kind}, number long, {', '.join(f'{c} long' for c in (*COUNTS, 'low_turn', 'last_turn', 'cost'))}, audit string, roles array<string>, texts array<string>"
    return chunks.mapInArrow(run, schema)


def repair_chunks(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The repair of ``turns`` (conv_id, turn, role, text) in chunks, by (conv_id, number) in the order of the conversation.

    Turns are taken by turn (nulls first), ties by role and text. A null role or text counts as one space, null conv_ids are one conversation; other columns
    are not read. A turn is blank (no character that is no white space), else a duplicate (its role and text were seen earlier), else truncated (the last such
    character is none of ``.!?``). Of the cheapest edits the audit with the least letters in ASCII is taken: D 4 (blank and duplicate turns must go), I 3, K 0,
    R 3, and 3 for a truncated turn that stays. Equal rows are held once with their number. A conversation of any length is spread over chunks and tasks.
    An empty table gives an empty result.
    """
    chunks = linked(cut_chunks(ordered_turns(turns), chunk_rows, chunk_chars))
    alone = F.col("prev").isNull() & F.col("next").isNull()
    rows = chunks.where(alone).withColumns({"path": F.lit(None).cast("binary"), "state": F.lit(START)})
    long_ = chunks.where(~alone)
    chain = write_table(long_.select("number", "prev", "next", "codes"), "long-conversations")
    if not chain.isEmpty():
        rows = rows.unionByName(long_.join(entered(true_paths(chain)), "number").select(rows.columns))
    return traced(rows)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, number, place, role, text: the turns after the repair, ordered by number (of the chunk) and place in it."""
    return repaired.select("conv_id", "number", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select("conv_id", "number", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def report(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; zeros and empty strings without turns.

    The chunks of a conversation pass through one task in order, a chunk at a time: a hash over its text can be had in no other way. It holds counts, the hash and the audit.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    names = ["gaps", *COUNTS[:-1], "cost"]

    def run(batches):
        now = None

        def closed():
            low, high = now["low"], now["high"]
            gaps = 0 if low is None else high - low + 1 - now["turns"]
            own = {"conv_id": pa.array([now["conv_id"]], typed), "gaps": [gaps], **{c: [now[c]] for c in names[1:]}, "audit": ["".join(now["audit"])], "repaired_sha256": [now["hash"].hexdigest()]}
            return pa.RecordBatch.from_pydict(own)

        for batch in batches:
            typed = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield closed()
                    now = dict.fromkeys((*names, "turns"), 0) | {"conv_id": r["conv_id"], "low": None, "high": None, "audit": [], "hash": hashlib.sha256(), "any": False}
                if r["audit"] is None:
                    continue
                for c in (*COUNTS, "cost"):
                    now[c] += r[c]
                # turns rise along the chunks, nulls first
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = r["last_turn"] if r["last_turn"] is not None else now["high"]
                now["audit"].append(r["audit"])
                if r["said"] is not None:
                    now["hash"].update((("\n" if now["any"] else "") + r["said"]).encode())
                    now["any"] = True
        if now is not None:
            yield closed()

    said = F.when(F.size("roles") > 0, F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n"))
    own = repaired.select("conv_id", "number", *COUNTS, "cost", F.col("low_turn").alias("low"), "last_turn", "audit", said.alias("said"))
    none = conversations.select(F.col("conv_id").cast(kind).alias("conv_id")).distinct().select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in own.dtypes if c != "conv_id"])
    rows = own.unionByName(none).repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return rows.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in names)}, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 sets the role to user; nulls are one space."""
    def some(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1).cast("int"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
