"""Expression trees: nested lists of node names and arguments, compiled to one Column.

A tree is ``[name, child, ...]``. A child is a tree, ``{"col": name}`` (a column's value),
``{"arg": n}`` (the n-th bound argument) or a constant. Conditions are null-safe: null
and blank are false. Nothing is evaluated as code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.errors import UNDEFINED, message
from rosterloom.functions.dates import days_between
from rosterloom.functions.text import same

Node = Callable[..., Column]


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _int(value: Column) -> Column:
    return value.cast("string").try_cast("double").cast("long")


#: Nodes that are conditions.
CONDITIONS: dict[str, Node] = {
    "truthy": lambda v: v.isNotNull() & (v.cast("string") != "") & ~(v.cast("string").isin("0", "0.0", "false") & (F.typeof(v) != "string")),
    "not_empty": lambda v: v.isNotNull() & (v.cast("string") != ""),
    "equal": lambda a, b: same(a, b),
    "equal_int": lambda a, b: _int(a) == _int(b),
    "greater": lambda a, b: _int(a) > _int(b),
    "later": lambda a, b: days_between(a, b) > 0,
    "and": lambda *c: _all(c),
    "or": lambda *c: _any(c),
    "not": lambda c: ~_true(c),
    "one_of": lambda v, *options: v.isin(*options) if all(not isinstance(o, Column) for o in options) else _any([v == o for o in options]),
}
#: Nodes that are values.
VALUES: dict[str, Node] = {
    "if": lambda c, a, b: F.when(_true(c), a).otherwise(b),
    "same_value": lambda a, b: F.when(_true(same(a, b)), F.lower(F.trim(a))),
    "days": lambda a, b: days_between(a, b),
    "days_apart": lambda a, b: days_between(a, b, absolute=True),
    "reject": lambda text, v=None: message("R", text, v),
    "error": lambda text, v=None: message("E", text, v),
    "clarify": lambda text, v=None: message("C", text, v),
    "entry": lambda m, key: F.element_at(m, key),
}


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= _true(c)
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= _true(c)
    return out


def compile_tree(tree, frame: DataFrame, arguments: list | None = None) -> Column:
    """The Column of a tree over ``frame``; unknown nodes and columns fail now, not in the run."""
    arguments = arguments or []
    if isinstance(tree, dict):
        if "arg" in tree:
            return compile_tree(arguments[tree["arg"]], frame, arguments)
        if tree["col"] not in frame.columns:
            return F.lit(None).cast("string")
        return F.col(f"`{tree['col']}`")
    if not isinstance(tree, list):
        return F.lit(tree)
    name, *children = tree
    if name == "found":  # how many columns have the text in their names: known when planning
        return F.lit(sum(children[0] in c for c in frame.columns)) > 0
    node = CONDITIONS.get(name) or VALUES.get(name)
    if node is None:
        raise ValueError(f"no tree node is named {name!r}")
    return node(*(compile_tree(c, frame, arguments) for c in children))


def strict(value: Column) -> Column:
    """As text, where no value is the text None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def guarded(value: Column) -> Column:
    """A value that could not be computed is the undefined error."""
    return F.coalesce(value, F.lit(UNDEFINED))


# The named trees, whose names and conditions must match. Arguments are columns or
# constants bound by the rule program.
_A = [{"arg": i} for i in range(6)]
_if_filled = ["if", ["not_empty", _A[0]], _A[0], ""]
_if_both = ["if", ["not_empty", _A[0]], ["if", ["not_empty", _A[1]], _A[1], ""], ""]
_if_both_or_reject = ["if", ["not_empty", _A[0]], ["if", ["not_empty", _A[1]], _A[1], ["reject", _A[2]]], ""]
_filled_or_clarify = ["if", ["not_empty", _A[0]], _A[0], ["clarify", _A[1], _A[0]]]
_yes_if_filled = ["if", ["not_empty", _A[0]], "Y", "N"]
_one_if_filled = ["if", ["not_empty", _A[0]], "1", "0"]
_for_individuals = ["if", ["equal", _A[0], "I"], ["if", ["not_empty", _A[1]], _A[1], ""], ""]
_if_flagged = ["if", ["not_empty", _A[1]], ["if", ["equal_int", _A[0], "1"], _A[1], ""], ""]

_SHAPES = [
    (_if_filled, "alternate_f_name mediCare licence_number cdsCsrNumber primarySpecialityOrSpecialityCode electronic_comm1 electronic_comm2 age_limit dir_ind"),
    (_if_both, "license_state cdsState cdsExpiryDate middleName"),
    (_if_both_or_reject, "state_license_effective_date licenseExpiryDate"),
    (_filled_or_clarify, "taxId npi"),
    (_yes_if_filled, "isCurrentDelDateNotEmpty isOrigDelDateNotEmpty isEffectiveDateNotEmpty"),
    (_one_if_filled, "var_board5"),
    (_for_individuals, "dob ssn"),
    (_if_flagged, "board_cert_date board_expiration_date"),
]
TREES: dict[str, list] = {name: tree for tree, names in _SHAPES for name in names.split()}
TREES |= {
    "enumerationDate": _A[0],
    "originalDelDate": ["if", ["not_empty", _A[0]], _A[0], ["reject", _A[1]]],
    # name, text, expected name
    "lastName": ["if", ["and", ["not_empty", _A[0]], ["not_empty", _A[2]]], ["same_value", _A[0], _A[2]], ["reject", _A[1], _A[0]]],
    # name, expected name, type of id, text
    "firstName": ["if", ["and", ["not_empty", _A[0]], ["not_empty", _A[1]]], ["same_value", _A[0], _A[1]], ["if", ["equal", _A[2], "G"], ["reject", _A[3]], "G"]],
    "alt_l_name": ["if", ["equal", _A[0], "G"], "", ["if", ["not_empty", _A[1]], _A[1], ""]],
    # date, reference day, then the texts for two years late, one year late, too far ahead
    "effectiveDate": [
        "if", ["not_empty", _A[0]],
        ["if", ["greater", ["days", _A[1], _A[0]], 730], ["reject", _A[2], _A[0]],
         ["if", ["greater", ["days", _A[1], _A[0]], 365], ["clarify", _A[3], _A[0]],
          ["if", ["greater", ["days", _A[0], _A[1]], 90], ["reject", _A[4], _A[0]], _A[0]]]],
        "",
    ],
    # first date, second date, flag, text
    "effectiveDate2": ["if", ["not_empty", _A[0]], _A[0], ["if", ["not_empty", _A[1]], _A[1], ["if", ["truthy", _A[2]], ["clarify", _A[3], _A[0]], ""]]],
    "credDateGreater1day": ["if", ["and", ["not_empty", _A[0]], ["greater", ["days", _A[0], _A[1]], 1]], "Y", "N"],
    "CurDelGreater2days": ["if", ["and", ["not_empty", _A[0]], ["greater", ["days_apart", _A[0], _A[1]], 2]], "Y", "N"],
    # date, flag, date to use if flagged, request flag, default
    "currentDelDate": ["if", ["not_empty", _A[0]], ["if", ["equal", _A[1], "Y"], _A[2], _A[0]], ["if", ["equal_int", _A[3], "1"], "Clarification for Cred Date", _A[4]]],
    "var_board1": ["if", ["or", *(["equal", _A[0], d] for d in ("DO", "MD", "PHD", "DPM"))], "1", "0"],
    "var_board2": "0",
    "var_board3": ["if", ["and", ["not_empty", _A[0]], ["not_empty", _A[1]]], "1", "0"],
    "var_board4": ["if", ["or", ["equal", _A[0], "Y"], ["equal", _A[0], "N"]], "1", "0"],
    # asked, answer, certified, dated, eligible
    "var_board8": [
        "if", ["equal_int", _A[0], "1"],
        ["if", ["equal", _A[1], "N"], "N",
         ["if", ["and", ["equal_int", _A[2], "1"], ["equal_int", _A[3], "1"]], "L",
          ["if", ["and", ["equal_int", _A[4], "1"], ["equal_int", _A[3], "1"]], "C", "N"]]],
        "X",
    ],
    "loc": ["if", ["not_empty", _A[2]], ["if", ["not_empty", _A[0]], _A[0], _A[1]], ""],
    "individual_medicaid": ["if", ["not_empty", _A[0]], _A[0], _A[1]],
}
