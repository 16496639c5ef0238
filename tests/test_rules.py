import pytest
from pyspark.sql import functions as F

from rosterloom import errors, schema
from rosterloom.functions import dates, hours, text, validate
from rosterloom.operators import documents, lookup, markup, reshape, update
from rosterloom.plans import pipeline, program, trees
from rosterloom.sources import config, spreadsheet, tables


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("kind", "value", "expected"),
    [("R", "x", "Reject: bad|Input: x"), ("E", "x", "Error: bad|Input: x"), ("r", "x", "Clarify: bad|Input: x"), ("C", "9999999999", "Clarify: bad|Input: "), ("C", None, "Clarify: bad|Input: ")],
)
def test_message(spark, kind, value, expected):
    assert one(spark, value, lambda v: errors.message(kind, "bad", v)) == expected


@pytest.mark.parametrize(("value", "expected"), [("Reject: a|Input: b", True), ("see CLARIFY: x", True), ("value", False), (None, False)])
def test_is_message(spark, value, expected):
    assert one(spark, value, errors.is_message) is expected


def test_message_parts_and_pass_through(spark):
    assert tuple(one(spark, "Error: a|Input: b", errors.parts)) == ("Error", "a", "b")
    assert one(spark, "Clarify: a|Input: ", text.phone) == "Clarify: a|Input: "


@pytest.mark.parametrize(("name", "ref"), [("PLSV@CITY@0", ("PLSV", "CITY", 0, None)), ("PRIM_PLSV@LANG#2@1", ("PRIM_PLSV", "LANG", 1, 2))])
def test_column_names(name, ref):
    found = schema.ColumnRef.parse(name)
    assert (found.tag, found.field, found.set, found.group) == ref and found.name == name
    assert schema.ColumnRef.parse("TAX_ID") is None


def test_headers():
    assert schema.clean_headers(["A\nb", "", None, "A b"]) == ["a b", "empty_column", "empty_column.1", "a b.1"]
    assert schema.header_row([["title", None], ["a", "b"], ["1", "2"]]) == 1
    assert schema.format_match(["a", "b", "c", "d"], ["a", "b", "c", "x"]) == 0
    assert schema.best_format(["a", "b"], {"2": ["a", "b"], "1": ["a", "b"]}) == ("1", 100)
    assert schema.map_headers(["npi", "tin"], {"NPI": ["npi no", "npi"], "TAX": ["npi", "tin"]}) == {"NPI": "npi", "TAX": "tin"}
    repeated = schema.map_repeated(["street", "phone", "phone 2", "street 2"], {"LINE": ["street", "street 2"], "PHONE": ["phone", "phone 2"]}, groups=frozenset({"PHONE"}))
    assert [r.name for r in repeated.values()] == ["GENERAL@LINE@0", "GENERAL@PHONE#0@0", "GENERAL@PHONE#1@0", "GENERAL@LINE@1"]
    assert schema.drift(["a", "b"], ["b", "c"]) == {"new": ["a"], "removed": ["c"], "unchanged": ["b"]}


@pytest.mark.parametrize(
    ("value", "expected"),
    [("1/2/2020", "01/02/2020"), ("2020-01-02", "01/02/2020"), ("1/2/20", "01/02/2020"), ("1/2/68", "01/02/1968"), ("43832", "01/02/2020"), ("Jan 2, 2020", "01/02/2020"), ("", ""), (None, ""), ("soon", "Reject: Invalid date|Input: soon")],
)
def test_parse_date(spark, value, expected):
    assert one(spark, value, dates.parse_date) == expected


@pytest.mark.parametrize(("value", "expected"), [("(312) 555-0100", "3125550100"), ("1-312-555-0100", "3125550100"), ("12", "Clarify: Invalid phone number|Input: 12"), ("", "")])
def test_phone(spark, value, expected):
    assert one(spark, value, text.phone) == expected


def test_text_rules(spark):
    assert one(spark, "312 555 0100 ext. 12", text.phone_extension) == "12"
    assert one(spark, "6012", text.zip5) == "06012"
    assert one(spark, "a; b,,c", text.tokens) == ["a", "b", "c"]
    assert one(spark, "Inn, dba Out", lambda v: text.tokens(v, whole_if="(?i)dba")) == ["Inn, dba Out"]
    assert one(spark, "P.O. Box 12", text.is_po_box) is True
    assert one(spark, "officePhoneNo", text.camel_words) == "office phone no"
    assert one(spark, "00", lambda v: validate.not_zeros(v)) == "Clarify: Only zeros|Input: 00"
    assert one(spark, "12a", validate.numeric) == "Clarify: Not numeric|Input: 12a"
    assert one(spark, "University Hospital", lambda v: text.abbreviate(v, 15, {"University": "Univ"})) == "Univ Hospital"
    assert one(spark, "x" * 20, lambda v: text.abbreviate(v, 15, {})).startswith("Clarify:")


def test_abbreviate_over_all_parts(spark):
    """Every row of the table and some that only the vowel step fits, against brute force."""
    import re

    def brute(v):
        steps = [re.sub(r"\s+", " ", v).strip()]
        steps.append(re.sub(r"\bBrand\b", "Br", steps[-1], flags=re.I))
        steps.append(re.sub(r"\s+", " ", re.sub(rf"\b({'|'.join(text.STOP_WORDS)})\b", "", steps[-1], flags=re.I)).strip())
        inner = lambda s, i: 0 < i < len(s) - 1 and s[i - 1].isalnum() and s[i + 1].isalnum()
        steps.append("".join(c for i, c in enumerate(steps[-1]) if c.lower() not in "aeiou" or not inner(steps[-1], i)))
        return next((x for x in steps if len(x) <= 12), f"Clarify: Too long|Input: {v}")

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.concat_ws(" of ", "p_name", "p_brand").alias("v"))
    made = spark.createDataFrame([("radiology unit",), ("a  pediatric of oak",), ("Brand of an apple",), ("xxxxxxxxxxxxxxx",)], "v string")
    rows = parts.unionByName(made).select("v", text.abbreviate(F.col("v"), 12, {"Brand": "Br"}).alias("r")).collect()
    assert [r.r for r in rows] == [brute(r.v) for r in rows]
    assert any(r.r.startswith("Clarify") for r in rows) and ("radiology unit", "rdlgy unt") in [tuple(r) for r in rows]


@pytest.mark.parametrize(("value", "days", "monday"), [("Mon-Fri 8-5", 5, ("08:00AM", "05:00PM")), ("M, W 7:30a-12p", 2, ("07:30AM", "12:00PM")), ("24/7", 7, ("12:00AM", "11:59PM")), ("Mon closed", 0, None), (None, 0, None), ("Fri-Mon 10am to 2pm", 4, ("10:00AM", "02:00PM"))])
def test_hours(spark, value, days, monday):
    found = spark.createDataFrame([(value,)], "v string").select(hours.working_hours(F.col("v")).alias("h")).first().h
    assert len(found) == days and (tuple(found["mon"]) if "mon" in found else None) == monday


def test_trees_fail_when_planned(spark):
    frame = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(ValueError):
        trees.compile_tree(["nothing", 1], frame)
    for name, tree in trees.TREES.items():
        trees.compile_tree(tree, frame, [{"col": "x"}] * 6), name


def test_unpivot_and_defaults(spark):
    wide = spark.createDataFrame([(1, "x", None, "5", "", None), (2, None, "", None, None, " ")], "id long, `A@F@0` string, `A@F@1` string, `A@P#0@0` string, `A@P#1@0` string, `A@P#0@1` string")
    rows = reshape.unpivot(wide, ["id"]).collect()
    assert [(r.id, r.tag, r.set_no, r.F, [g.value for g in r.P]) for r in rows] == [(1, "A", 0, "x", ["5"])]
    base = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted((r.id, r.F) for r in reshape.default_row(base, reshape.unpivot(wide, ["id"]), ["id"], {"F": ""}).collect()) == [(1, "x"), (2, "")]


def test_zip_fill_repeats_the_last(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c"], ["x"]), (2, [], ["y"])], "id long, p array<string>, q array<string>")
    rows = sorted((r.id, r.row_no, r.p_item, r.q_item) for r in reshape.zip_fill(frame, ["p", "q"]).filter("id = 1").collect())
    assert rows == [(1, 1, "a", "x"), (1, 2, "b", "x"), (1, 3, "c", "x")]
    assert reshape.zip_fill(frame, ["p", "q"], repeat_last=False).filter("id = 1 and q_item is null").count() == 2


def test_lookup_does_not_depend_on_order(spark):
    grid = spark.createDataFrame([(0, "cardiology"), (1, "cardio logy"), (2, "family medicine")], "grid_no int, name string")
    asked = spark.createDataFrame([("cardiolgy",), ("medicine family",), ("zzz",), ("",), (None,)], "q string")
    want = {"cardiolgy": 0, "medicine family": 2, "zzz": None, "": None, None: None}
    for frame in (asked, asked.repartition(3).orderBy(F.desc("q"))):
        assert {r.q: r.grid_no for r in lookup.lookup_fuzzy(frame, "q", grid.repartition(2), "name").collect()} == want


def test_lookup_beyond_any_grid_size(spark):
    """A typo in the only word is found in a large grid, by every way of looking up."""
    grid = spark.range(20_500).select(F.col("id").cast("int").alias("grid_no"), F.when(F.col("id") == 20_400, "widget").when(F.col("id") == 20_401, "blue gadget").otherwise(F.concat(F.lit("w"), F.md5(F.col("id").cast("string")))).alias("name"))
    asked = spark.createDataFrame([("widgt",), ("bleu gadgett",), ("zzz",)], "q string")
    assert {r.q: r.grid_no for r in lookup.lookup_fuzzy(asked, "q", grid, "name").collect()} == {"widgt": 20_400, "bleu gadgett": 20_401, "zzz": None}
    assert {r.q: r.grid_no for r in lookup.lookup_fuzzy(asked, "q", grid, "name", 2, every=True, restrict=True).collect()} == {"widgt": 20_400, "bleu gadgett": 20_401, "zzz": None}
    assert {(r.q, r.grid_no, r.rung) for r in lookup.lookup_ladder(asked, "q", grid, "name").collect()} == {("widgt", 20_400, "fuzzy"), ("bleu gadgett", None, "none"), ("zzz", None, "none")}


@pytest.mark.parametrize(("edits", "every", "restrict"), [(0, False, False), (1, False, False), (1, True, True), (2, True, False)])
def test_lookup_matches_the_nested_loop(spark, edits, every, restrict):
    import random

    pick = random.Random(edits)
    phrase = lambda: " ".join("".join(pick.choice("abc") for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(1, 3)))
    grid, asked = [(i, phrase()) for i in range(25)], sorted({phrase() for _ in range(40)})

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            last, row = row, [i + 1] + [0] * len(y)
            for j, b in enumerate(y):
                row[j + 1] = min(last[j + 1] + 1, row[j] + 1, last[j] + (a != b))
        return row[-1]

    def best(q):
        found = []
        for no, name in grid:
            a, b = q.split(), name.split()
            hit = sum(any(distance(x, y) <= edits for y in b) for x in a)
            if hit and (hit == len(a) or not every) and (len(a) == len(b) or not restrict):
                found.append((-(hit + (len(a) + 1 if len(a) == len(b) else 0)), distance(q, name), no))
        return min(found)[2] if found else None

    got = lookup.lookup_fuzzy(spark.createDataFrame([(q,) for q in asked], "q string"), "q", spark.createDataFrame(grid, "grid_no int, name string"), "name", edits, every, restrict)
    assert {r.q: r.grid_no for r in got.collect()} == {q: best(q) for q in asked}


def test_fill_and_duplicates(spark):
    frame = spark.createDataFrame([(1, 1, ""), (1, 2, "b"), (1, 3, None), (2, 1, " ")], "k int, o int, v string")
    assert [r.v for r in update.fill_group(frame, "v", ["k"], ["o"]).orderBy("k", "o").collect()] == ["b", "b", "b", ""]
    assert [r.v for r in update.forward_fill(frame, "v", ["k"], ["o"]).orderBy("k", "o").collect()] == [None, "b", "b", None]


def test_documents(spark):
    words = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 2.0, "Name"), (1, 1, 6.0, 0.5, 9.0, 2.0, "Ann"), (1, 1, 0.0, 10.0, 5.0, 12.0, "Page"), (1, 1, 30.0, 10.0, 35.0, 12.0, "2")], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, word string")
    assert [r.text for r in documents.text_lines(words).orderBy("line_no").collect()] == ["Name Ann", "Page 2"]
    assert documents.anchors(words, "name").first().anchor_x1 == 5.0
    assert documents.table_columns(words).select("column_no").distinct().count() == 2


def test_mail(spark):
    html = "<p>From: Ann<br>Sent: Monday<br>To: Bob<br>Subject: Roster &amp; more</p><script>x</script> Body: please add"
    row = markup.mail_fields(spark.createDataFrame([(html,)], "h string"), "h").first()
    assert (row["from"], row.sent, row.to, row.subject, row.body) == ("Ann", "Monday", "Bob", "Roster & more", "please add")


def test_workbook_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("Title", None, None), ("Last Name", "NPI\nno", "npi no"), ("Ä & <b>", "123", None), (None, " ", None)], "a string, b string, c string")
    content = spreadsheet.workbook({"tab one": frame})
    (tmp_path / "x.xlsx").write_bytes(content)
    cells = spreadsheet.read_cells(spark, str(tmp_path))
    assert cells.count() == 5
    tab = spreadsheet.tab_frame(cells.filter("row_ix > 0"), "tab one")
    assert tab.columns == ["row_ix", "last name", "npi no", "npi no.1"]
    assert [r["last name"] for r in tab.collect()] == ["Ä & <b>"]


def test_tabs_of_several_files(spark, tmp_path):
    """Headers at other places and in another order, below row 100 too; blank rows between stay, trailing ones go."""
    first = spark.createDataFrame([*(("note", None),) * 120, ("A", "B"), ("1", "2"), (None, None), ("3", None), ("", " ")], "a string, b string").coalesce(1)
    second = spark.createDataFrame([("B", "C"), ("5", "6")], "a string, b string").coalesce(1)
    (tmp_path / "x.xlsx").write_bytes(spreadsheet.workbook({"t": first, "other": second}))
    (tmp_path / "y.xlsx").write_bytes(spreadsheet.workbook({"t": second}))
    cells = spreadsheet.read_cells(spark, str(tmp_path)).filter("row_ix > 0")
    rows = [(r.file[-6:], r.a, r.b, r.c) for r in spreadsheet.tab_frame(cells, "t", with_file=True).orderBy("file", "row_ix").collect()]
    assert rows == [("x.xlsx", "1", "2", None), ("x.xlsx", None, None, None), ("x.xlsx", "3", None, None), ("y.xlsx", None, "5", "6")]


def test_report_sheets(spark):
    inputs = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    sheets = tables.report_sheets({"t": spark.createDataFrame([(1, "x")], "k int, v string")}, inputs, ["k"])
    assert sorted(sheets) == ["CONSOLIDATED", "META", "RECONCILIATION", "t"] and sheets["META"].count() == 2
    assert {r.k: r.state for r in sheets["RECONCILIATION"].collect()} == {1: "partial", 2: "missing"}
    assert spreadsheet.workbook(sheets)[:2] == b"PK"


@pytest.mark.parametrize(("name", "rest"), [("phone", {"arguments": {"value": {"col": "z"}}}), ("nothing", {}), ("zip5", {"arguments": {"valeu": {"col": "x"}}}), ("tree", {"arguments": {"tree": ["no node"]}})])
def test_failed_rules_are_trapped(spark, name, rest):
    frames, trapped = {"f": spark.createDataFrame([("a",)], "x string")}, []
    layers = [{"layer": "l", "type": "ROW", "steps": [{"frame": "f", "rule": name, "output": "y", **rest}, {"frame": "f", "rule": "value_or", "output": "w", "arguments": {"value": {"col": "y"}, "otherwise": {"col": "x"}}}]}]
    layers.append({"layer": "d", "type": "DF", "steps": [{"frame": "f", "rule": "keep_where", "arguments": {"where": {"col": "z", "equals": 1}}}]})
    row = program.run_program(layers, frames, trapped=trapped)["f"].first()
    assert row.asDict() == {"x": "a", "y": errors.UNDEFINED.split("|")[0] + "|Input: ", "w": "Error: Undefined Error|Input: "} and len(trapped) == 2


def test_row_steps_become_one_projection(spark):
    frame = spark.createDataFrame([(" a",)], "x string")
    step = lambda out, of: {"frame": "f", "rule": "value_or", "output": out, "arguments": {"value": {"col": of}, "otherwise": "n"}}
    layers = [{"layer": "l", "type": "ROW", "steps": [step("a", "x"), step("b", "x"), step("c", "a"), step("x", "b"), step("d", "x")]}]
    out = program.run_program(layers, {"f": frame})["f"]
    assert out.first().asDict() == dict.fromkeys("xabcd", " a")
    assert out._jdf.queryExecution().logical().toString().count("Project [") <= 4


def test_saved_mappings_and_schemas():
    saved = {"0": {"format": ["A", "B"], "mappings": {"sv": {"a": "NAME_LAST"}, "mv": {"ADDR": {"b": "PLSV@LINE@1", "c": "no"}}}}, "1": {"diheader": ["x"], "mappings": "to be ignored"}}
    found = config.saved_mappings(saved)
    assert found["1"].ignored and found["0"].single == {"a": "NAME_LAST"} and found["0"].repeated["ADDR"]["b"].set == 1
    assert config.aliases({"F": {"Input_Column": ["a"]}, "G": {"Column_Type": [{"Tag": "T", "Input_Column": ["b", "c"]}]}}) == {"F": ["a"], "G": ["b", "c"]}


def test_json_files_are_read(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"LayerName": "a", "LayerType": "ROW",\n "Transformation": [{"f": {"derivations": []}}]}]')
    assert config.program(config.read_json(spark, str(tmp_path / "p.json"))) == [{"layer": "a", "type": "ROW", "steps": []}]


def test_stemmed_words_meet(spark):
    asked = spark.createDataFrame([("running shoes",), ("cities",), ("class",)], "v string")
    grid = spark.createDataFrame([(0, "run shoe"), (1, "city"), (2, "runn shoe"), (3, "class")], "grid_no int, name string")
    found = {r.v: r.name for r in lookup.lookup_fuzzy(asked, "v", grid, "name", 0, stemmed=True).collect()}
    assert found == {"running shoes": "runn shoe", "cities": "city", "class": "class"}


def test_tables_out(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    tables.write_tables({"t": frame}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert sorted(r.record for r in tables.as_records(frame).collect()) == ['{"k":1,"v":"a"}', '{"k":2,"v":null}']
    assert tables.counts_sheet({"t": frame}, "k").first().n_ids == 2
    with pytest.raises(ValueError):
        tables.as_document(frame, 1)


def test_whole_run(spark):
    raw = spark.createDataFrame(
        [("1", "", "12-3", "Ann", "Lee", "add", "Main St", "Elm St", "x"), ("1", "", "12-3", "Ann", "Lee", "add", "Main St", "n/a", "y"), ("", "7", "9", "Bob", "Ray", "", None, "", "z"), ("", "", "", "", "", "", "", "", "")],
        "npi string, grp string, tin string, first string, last string, act string, s1 string, s2 string, note string",
    )
    mapping = {"npi": "INDIVIDUAL_NPI", "grp": "GROUP_NPI", "tin": "TAX_ID", "first": "NAME_FIRST", "last": "NAME_LAST", "act": "ACTION", "s1": "PLSV@LINE@0", "s2": "PLSV@LINE@1", "note": "NOTE"}
    out_schema = [{"outputColName": "Id", "dfColName": "FINAL_NPI", "dataType": "numeric", "format": "0000"}, {"outputColName": "Line", "dfColName": "LINE"}, {"outputColName": "Note", "dfColName": "NOTE_message"}, {"outputColName": "First", "dfColName": "FIRST_ROW"}]
    layers = [{"layer": "clean", "type": "ROW", "steps": [{"frame": "address", "rule": "replace_words", "output": "LINE", "arguments": {"value": {"col": "LINE"}, "words": {"St": "Street"}}}]}]
    done = pipeline.run(raw, mapping, {"address": ["LINE"]}, {"PRAC ADD": layers, "DEMO OTHER": []}, {"PRAC ADD": out_schema, "DEMO OTHER": out_schema}, {"PRAC ADD": "address"}, {"add": "PRAC ADD"})
    rows = sorted(tuple(r) for r in done["PRAC ADD"].collect())
    assert [(r[0], r[1], r[3]) for r in rows] == [("0001", "Elm Street", "N"), ("0001", "Main Street", "Y")]
    assert rows[0][2].startswith("Clarify: Multiple values found")
    assert [tuple(r)[0] for r in done["DEMO OTHER"].collect()] == ["0007"]


def test_program_names_are_checked(spark):
    frames = {"f": spark.createDataFrame([("a",)], "x string")}
    for step in ({"frame": "g", "rule": "phone"}, {"frame": "f", "rule": "nothing", "output": "y"}, {"frame": "f", "rule": "phone", "output": "y", "arguments": {"value": {"col": "z"}}}):
        with pytest.raises(ValueError):
            program.run_program([{"layer": "l", "type": "ROW", "steps": [step]}], frames)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_rows_that_fail_while_running(spark, ansi):
    """The same rows fail, alone, in either mode; nulls, structs and rules that name a value twice too."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        frame = spark.createDataFrame([(0, 0, "x"), (1, 2, "7"), (2, None, None)], "k int, a int, s string")
        program.ROW_RULES["test.twice"] = lambda v: 1 / v + 1 / v
        program.ROW_RULES["test.pair"] = lambda v: F.struct((10 / v).alias("x"), F.array(v).alias("y"))
        steps = [{"rule": r, "output": o, "arguments": [{"col": c}]} for r, o, c in (("twice", "t", "a"), ("pair", "p", "a"), ("number", "n", "s"), ("pair", ["x", "y"], "a"))]
        rows = program.run_program([{"layer": "", "type": "ROW", "steps": [{"frame": "f", **s} for s in steps]}], {"f": frame}, scope="test", trapped=[])["f"].orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
        for name in ("test.twice", "test.pair"):
            del program.ROW_RULES[name]
    assert [(r.t, r.n, r.x) for r in rows] == [(errors.UNDEFINED, errors.UNDEFINED, errors.UNDEFINED), ("1.0", "7", "5.0"), (None, None, None)]
    assert rows[0].p is None and tuple(rows[1].p) == (5.0, [2]) and tuple(rows[2].p) == (None, [None]) and rows[1].y == [2]


def test_dynamic_columns_are_bounded(spark):
    frame = spark.range(30).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("v").alias("_named"))
    wide = program.dynamic_columns(frame, F.create_map("name", F.lit("x")), most=30)
    assert len(wide.columns) == 33 and wide.filter("n7 = 'x'").count() == 1 and wide.columns[:3] == ["id", "name", "_named"]
    with pytest.raises(ValueError, match="more than 29 names"):
        program.dynamic_columns(frame, F.create_map("name", F.lit("x")), most=29)
    assert program.dynamic_columns(frame.limit(0), F.create_map("name", F.lit("x"))).columns == frame.columns


def test_header_assignment_is_sequential(spark):
    """Every header in turn takes its best free field, against a plain walk over all aliases."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(9)
    base = ["npi number", "tax id", "last name", "first name", "phone", "phone no", "city", "zip", "a", "aaaa aaaa"]
    typo = lambda w: "".join(c for c in w if rng.random() > 0.08) + rng.choice(["", "", "s", " 1", "x"])
    aliases = {f"F{i % 7}{i // 7}": [typo(b), b] if i % 2 else [typo(b)] for i, b in enumerate(base * 2)}
    counts = {"F00": 3, "F10": 2}
    files = [(f, p, rng.choice([str.upper, str])(typo(rng.choice(base)))) for f in range(40) for p in range(12)] + [(99, 0, ""), (98, 0, None)]
    want = []
    for f in {r[0] for r in files}:
        taken = {}
        for _, place, header in sorted(r for r in files if r[0] == f):
            h = (header or "").lower()
            score = lambda field: max(round(100 * (max(len(h), len(a)) - distance(h, a)) / max(len(h), len(a)), 4) for a in aliases[field] if a)
            free = [(-score(x), x) for x in aliases if taken.get(x, 0) < counts.get(x, 1) and h and score(x) > 75]
            best = min(free, default=(None, None))
            taken[best[1]] = taken.get(best[1], 0) + 1
            want.append((f, place, header, best[1], None if best[0] is None else -best[0]))
    got = schema.assign_headers(spark.createDataFrame(files, "file long, place int, header string").repartition(4), aliases, counts).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(w[3] is not None for w in want) > 150


def test_texts_without_words_are_not_found(spark):
    grid = spark.createDataFrame([(1, "--"), (2, "one"), (3, None)], "grid_no int, name string")
    asked = spark.createDataFrame([("?!",), ("ONE",), ("",), (None,)], "v string")
    for found in (lookup.lookup_exact(asked, "v", grid, "name"), lookup.lookup_fuzzy(asked, "v", grid, "name", every=True), lookup.lookup_ladder(asked, "v", grid, "name")):
        assert {r.v: r.grid_no for r in found.collect()} == {"?!": None, "ONE": 2, "": None, None: None}


@pytest.mark.parametrize(("every", "least", "edits"), [(True, 0.0, 1), (False, 0.6, 1), (False, 0.5, 0), (True, 0.0, 2)])
def test_rarest_words_find_all_matches(spark, every, least, edits):
    """The pairs of texts that ask by their rarest words, against all pairs."""
    import random

    rng = random.Random(11)
    terms = ["hot", "hott", "clinic", "clinik", "red", "read", "bed", "blue", "glue", "north", "a", "an"]
    make = lambda: " ".join(["hot", *(rng.choice(terms) for _ in range(rng.randint(0, 4)))])
    asked = spark.createDataFrame([(str(i), make()) for i in range(60)], "_asked string, _text string")
    grid = spark.createDataFrame([(i, make()) for i in range(80)], "grid_no int, name string")
    got = {(r._asked, r.grid_no) for r in lookup.scored_pairs(asked, grid, "name", edits, every=every, least=least).collect()}
    pairs = asked.crossJoin(grid).withColumn("q", lookup.words(F.col("_text"))).withColumn("g", lookup.words(F.col("name")))
    hit = F.size(F.filter("q", lambda q: F.exists("g", lambda g: F.levenshtein(q, g) <= edits)))
    want = {(r._asked, r.grid_no) for r in pairs.filter(hit >= F.greatest(F.size("q") * (1.0 if every else least), F.lit(1))).collect()}
    assert got == want and len(want) > 20
