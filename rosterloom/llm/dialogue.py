"""Repair of a conversation's structure by the cheapest edits that make its roles alternate.

A conversation is walked row by row through the states of ``(s?(ua)+)?``: rows are kept, given the
role that is due, or deleted, and missing turns are inserted. Iterative-deepening A* tries the
edits of each state in the order of their letters, depth first, under a bound of cost that
grows to the least one beyond it, so that the first path that is accepted is the cheapest one
and the first by letters of those. What a state is known to need at least, its faults ahead at
first and more after it failed, stays in a table, so that no state is searched again in vain.

Spark orders the rows of each conversation and marks their faults; only a letter and a digest of
each row go to the search, texts stay in the JVM.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of edits, the chance of damage in ``DAMAGE``, and the roles by their initials.
DELETE, INSERT, REROLE, TRUNCATED, DAMAGE = 4, 3, 3, 3, 20
ROLES = {"s": "system", "u": "user", "a": "assistant"}

_SPACE = r"[\x20\x09-\x0D]"
#: States: nothing yet, system said, user said, assistant said; which role comes next, and where it leads.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_DUE = {_START: {"s": _SYSTEM, "u": _USER}, _SYSTEM: {"u": _USER}, _USER: {"a": _ASSISTANT}, _ASSISTANT: {"u": _USER}}
_MADE = {_START: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}
_NEVER = 1 << 60

#: Initials of truncated rows, which the search sees as their place in it.
_CUT = "suao"


def _row_code(initial: str, fault: str) -> str:
    """A row as the search sees it: its initial (o for others), in upper case if the row has to go."""
    letter = initial if initial in ROLES else "o"
    return letter.upper() if fault in ("blank", "duplicate") else str(_CUT.index(letter)) if fault == "truncated" else letter


def _edits(code: str) -> list[list[tuple[str, int, int, int]]]:
    """By state: (letter, cost, rows passed, next state), in the order of the letters; code '' is the end."""
    out = []
    for state in range(4):
        insert = ("I", INSERT, 0, _DUE[state][_MADE[state]])
        if not code:
            out.append([insert])
            continue
        cut = code.isdigit()
        initial, extra = _CUT[int(code)] if cut else code, TRUNCATED if cut else 0
        found = [("D", DELETE, 1, state), insert]
        if not code.isupper():
            if initial in _DUE[state]:
                found.append(("K", extra, 1, _DUE[state][initial]))
            found.append(("R", REROLE + extra, 1, _DUE[state][_MADE[state]]))
        out.append(found)
    return out


_EDITS = {code: _edits(code) for code in ["", *"suao", *"SUAO", *"0123"]}


def _ahead(code: str) -> int:
    """What a row costs at least, in any state."""
    return DELETE if code.isupper() else TRUNCATED if code.isdigit() else 0


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a conversation of such rows, the first by letters of equals."""
    n = len(codes)
    need, low = [0] * (4 * n + 4), 0
    for i in range(n - 1, -1, -1):
        low += _ahead(codes[i])
        need[4 * i : 4 * i + 4] = [low] * 4
    table = [_EDITS[c] for c in codes] + [_EDITS[""]]
    while True:
        bound = need[0]
        # Of each state on the path: itself, what is left to spend, its next edit, and the least that one of its edits was found to need.
        path, letters = [[0, bound, 0, _NEVER]], []
        while path:
            top = path[-1]
            state, left, move, _ = top
            i, at = state >> 2, state & 3
            if i == n and at in (_START, _ASSISTANT):
                return bound, "".join(letters)
            edits = table[i][at]
            while move < len(edits):
                letter, cost, rows, then = edits[move]
                move += 1
                to = ((i + rows) << 2) | then
                least = cost + need[to]
                if least <= left:
                    top[2] = move
                    path.append([to, left - cost, 0, _NEVER])
                    letters.append(letter)
                    break
                if least < top[3]:
                    top[3] = least
            else:
                # The state failed: it needs the least of its edits.
                if top[3] > need[state]:
                    need[state] = top[3]
                path.pop()
                if path:
                    letters.pop()
                    above = path[-1]
                    letter, cost, _, _ = table[above[0] >> 2][above[0] & 3][above[2] - 1]
                    above[3] = min(above[3], cost + need[state])


_remembered = lru_cache(maxsize=1 << 14)(cheapest)


def _search(codes: str) -> tuple[int, str]:
    return _remembered(codes) if len(codes) <= 64 else cheapest(codes)


def _judge(initials, faults):
    """Counts, cost, letters and the rows of the repaired conversation: (row or -1, initial if it is another)."""
    codes = "".join(map(_row_code, initials, faults))
    cost, audit = _search(codes)
    rows, roles, i, state = [], [], 0, _START
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        initial = initials[i] if letter == "K" else _MADE[state]
        rows.append(-1 if letter == "I" else i)
        roles.append("" if letter == "K" else initial)
        state = _DUE[state][initial]
        i += letter != "I"
    pairs = [a + b for a, b in zip(initials, initials[1:])]
    faulty = [sum(f == kind for f in faults) for kind in ("blank", "duplicate", "truncated")]
    return *faulty, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, rows, roles


_KINDS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, rows array<int>, roles array<string>"
_RESULT = [field.split()[0] for field in _KINDS.split(", ")]


def _repaired(marks: pd.Series) -> pd.DataFrame:
    out = []
    for rows in marks:
        seen, initials, faults = set(), [], []
        for row in rows:
            again = row["key"] in seen
            seen.add(row["key"])
            initials.append(row["initial"])
            faults.append("blank" if row["blank"] else "duplicate" if again else "truncated" if row["cut"] else "")
        out.append(_judge(initials, faults))
    return pd.DataFrame(out, columns=_RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``, the rows of each turn after damage: none, one, or two that are equal.

    A CRC of the row's ids decides its damage, alike in every run. Nulls of role and text are one
    space; a null turn stays null.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % DAMAGE
    text = F.when(chance == 1, F.lit("")).when(chance == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    row = F.struct(F.col("turn"), F.when(chance == 4, F.lit("user")).otherwise(filled("role")).alias("role"), text.alias("text"))
    return conversations.select("conv_id", row.alias("row"), chance.alias("chance")).select("conv_id", F.array_repeat("row", F.when(F.col("chance") == 0, 0).when(F.col("chance") == 3, 2).otherwise(1)).alias("turns"))


def _gaps(turns: Column) -> Column:
    known = F.array_compact(F.transform(turns, lambda r: r["turn"]))
    return F.coalesce(F.array_max(known) - F.array_min(known) + 1 - F.size(F.array_distinct(known)), F.lit(0)).cast("long")


def _marks(turns: Column) -> Column:
    def of(row):
        bare = F.regexp_replace(row["text"], f"{_SPACE}+$", "")
        # The role's length keeps (role, text) pairs apart that are equal as one string.
        key = F.md5(F.concat(F.length(row["role"]).cast("string"), F.lit(":"), row["role"], row["text"]).cast("binary"))
        return F.struct(F.substring(row["role"], 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), key.alias("key"))

    return F.transform(turns, of)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turns): its faults, the cheapest edits, and ``repaired``, its rows after them.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired, an array of
    (role, text). Rows are taken by turn (null first), rows of one turn by role and text, so that
    repeated rows are neighbours. Empty texts are blank; very long texts are kept whole and only
    their digest is searched; a null conv_id is a conversation too; one without rows has zeros and
    nothing repaired. An empty table gives no row; other columns are ignored, whatever their names.
    """
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"))
    found = whole.withColumn("found", F.pandas_udf(_repaired, _KINDS)(_marks(F.col("turns"))))
    role = lambda i, named: F.when(named == "", F.get("turns", i)["role"]).otherwise(F.element_at(F.create_map(*(F.lit(x) for p in ROLES.items() for x in p)), named))
    made = F.zip_with("found.rows", "found.roles", lambda i, named: F.struct(role(i, named).alias("role"), F.when(i < 0, F.lit("")).otherwise(F.get("turns", F.greatest(i, F.lit(0)))["text"]).alias("text")))
    return found.select("conv_id", _gaps(F.col("turns")).alias("gaps"), *(f"found.{c}" for c in _RESULT[:6]), made.alias("repaired"))


def repaired_digest(repaired: Column) -> Column:
    return F.sha2(F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n").cast("binary"), 256)
