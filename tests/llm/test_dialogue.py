import hashlib
import heapq
import random
import re
import time
import zlib

from pyspark.sql import functions as F

from rosterloom.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(key.encode()) % 20
        row = (conv, turn, "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
        out += [row] * {0: 0, 3: 2}.get(n, 1)
    return out


def least_edits(rows):
    """Uniform-cost search over (cost, letters): the cheapest edits, the first by letters of those, and what they give."""
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        steps = []
        for initial, role in (("u", "user"), ("a", "assistant")):
            steps.append((3, "I", i, initial, ((role, ""),)))
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((4, "D", i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                steps.append((extra, "K", i + 1, role[:1] or "?", ((role, text),)))
                steps += [(3 + extra, "R", i + 1, r[0], ((r, text),)) for r in ("user", "assistant")]
        for c, letter, j, initial, more in steps:
            if re.fullmatch("s?(ua)*u?", roles + initial):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + initial, out + more))


def brute(rows):
    after, out = damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in own:
            bare = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[0] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, repaired = least_edits(marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def found(frame):
    out = dialogue.repair(dialogue.damaged(frame)).withColumn("sha", dialogue.repaired_digest(F.col("repaired"))).drop("repaired")
    return sorted(map(tuple, out.collect()), key=str)


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "system" if turn == 0 and rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn + rng.choice([0, 0, 0, 2]), rng.choice([role] * 12 + ["tool", "", None, "u2", "System"]), rng.choice(["Yes.", "No!", "So? ", "cut off", "", " \n", None, f"Own {conv} {turn}.", f"Own {conv} {turn}\t"])))
    return rows


def test_edits_are_those_of_brute_force(spark):
    rows = conversations(4, 160, 6) + [(None, None, "user", "Hi."), (None, 1, "assistant", "Yes."), (900, None, "user", "A."), (900, None, "assistant", "B."), (901, 3, None, None)] + [(902, i, "user", "A.") for i in range(4)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_order_of_letters_decides_ties():
    # Deleting both costs 8, inserting an answer after each 6, making the second one an answer 3.
    assert dialogue.cheapest("uu") == (3, "KR")
    assert dialogue.cheapest("") == (0, "") and dialogue.cheapest("U") == (4, "D") and dialogue.cheapest("u") == (3, "KI") and dialogue.cheapest("s") == (4, "D")
    assert dialogue.cheapest("a") == (3, "IK") and dialogue.cheapest("o") == (4, "D")


def test_long_conversations_end_soon():
    rng = random.Random(1)
    codes = "".join(rng.choice("ua"[i % 2] * 17 + "uU1") for i in range(3000))
    began = time.perf_counter()
    cost, audit = dialogue.cheapest(codes)
    assert time.perf_counter() - began < 30 and cost > 500 and len(audit) >= 3000


def test_odd_rows(spark):
    rows = [(1, 0, "user", "x" * 100_000 + "."), (1, 0, "user", "x" * 100_000 + "."), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "", ""), (3, 1, "assistant", "漢字。"), (3, 0, "user", "Ünï?")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"turns": F.lit(1), "row": F.lit(2), "chance": F.lit(3), "found": F.lit(4)})
    assert found(frame) == brute(rows)
    assert found(frame.limit(0)) == []
