"""Conversation repairs against a search over all edits kept as whole strings, with chunks of every size."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from wardlight.llm import conversation_repair as op11
from wardlight.llm.conversation_repair import damage, repair_chunks, repaired_turns, report

FIELDS = "conv_id long, turn long, role string, text string"
FOLLOW = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    """Forward search; a state is what came last, with (cost, audit, turns)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts = set(), Counter()

    def inserted(best):
        for _ in range(3):
            for last, (c, a, out) in list(best.items()):
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
                new = (c + 3, a + "I", [*out, ("user" if to == "u" else "assistant", "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserted({"": (0, "", [])})
    for k, (_, role, text) in enumerate(rows):
        bare = text.strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        counts["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        after = {}
        for last, (c, a, out) in best.items():
            options = [(last, c + 4, a + "D", out)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if (last, role[:1]) in FOLLOW:
                    options.append((role[:1], c + extra, a + "K", [*out, (role, text)]))
                for other in ("user", "assistant"):
                    if (last, other[0]) in FOLLOW:
                        options.append((other[0], c + 3 + extra, a + "R", [*out, (other, text)]))
            for to, *new in options:
                if to not in after or tuple(new[:2]) < after[to][:2]:
                    after[to] = tuple(new)
        best = inserted(after)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    said = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, said, out


def conversations(seed=3):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "User", "tool", "", None, "super", "uncle"]
    said = ["Yes.", "No!", "Why?", "cut", "cut off, ", "", " \n\t", None, "Ok. \r\n", "ä", "1", "2", "3.", "4.", "5."]
    out = []
    for conv in [*range(30), None]:
        for _ in range(r.randrange(1, 14)):
            out.append((conv, r.choice([None, *range(12)]), r.choice(roles), r.choice(said)))
    out += [(50, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(60)]
    out += [(51, t, "user", f"turn {t}" if t % 3 else f"turn {t}.") for t in range(60)]
    out += [(52, t, "tool", f"turn {t}") for t in range(60)]  # all are deleted: the vectors never meet
    out += [(53, t, "user", "") for t in range(60)] + [(53, 60, "assistant", "end.")]
    out += [(54, 1, "user", "same.")] * 40 + [(55, None, "assistant", "a.")] * 3
    return out


@pytest.mark.parametrize(("size", "passes"), [(1, 3), (2, 0), (3, 1), (256, 3)])
def test_against_all_edits(spark, monkeypatch, size, passes):
    monkeypatch.setattr(op11, "PASSES", passes)
    rows = conversations()
    df = spark.createDataFrame(rows, FIELDS).withColumns({"number": F.lit("n"), "cost": F.lit("c"), "path": F.lit("p")}).repartition(5)
    groups = defaultdict(list)
    for c, *rest in rows:
        groups[c].append(rest)
    repaired = repair_chunks(df, size)
    got = {r.conv_id: tuple(r)[1:] for r in report(repaired, df).collect()}
    assert got == {c: brute(g)[:-1] for c, g in groups.items()}
    turns = defaultdict(list)
    for r in repaired_turns(repaired).orderBy("number", "place").collect():
        turns[r.conv_id].append((r.role, r.text))
    assert turns == {c: out for c, g in groups.items() if (out := brute(g)[-1])}


def test_damage_and_conversations_without_turns(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()] + [(None, 1, "user", "a."), (7, None, None, None), (-3, 0, "system", None)]
    rows += [(c, 0, "user", "gone.") for c in range(10**6, 10**6 + 40)]
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else "".join(x for x in text if x not in ".!?") if d == 2 else text
        want += [(c, t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    df = spark.createDataFrame(rows, FIELDS)
    assert Counter(map(tuple, damage(df).collect())) == Counter(want)
    got = {r.conv_id: r for r in report(repair_chunks(damage(df)), df).collect()}
    assert set(got) == {r[0] for r in rows}
    lost = set(got) - {w[0] for w in want}
    assert lost and all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in lost)
    nothing = spark.createDataFrame([], FIELDS)
    assert report(repair_chunks(damage(nothing)), nothing).count() == 0 and repair_chunks(nothing).count() == 0
