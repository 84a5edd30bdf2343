import gzip
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality import (
    crosstab,
    flatten_forms,
    flatten_structs,
    lookup,
    parse_json,
    publish,
    read_csv,
    read_json,
    read_table,
    score_and_publish,
    score_forms,
    score_votes,
    split_json_rejects,
    unnest,
    write_csv,
    write_json,
    write_table,
)
from plurality.schema import CSV_SCHEMA, FORM_SCHEMA, PAYLOAD_COLUMN, SECTIONS_SCHEMA
from plurality.session import scratch_path
from plurality.sources import borders, files
from votes import EDGE, LAYOUT, E, N, S, frame

HEADER = ",".join(["", *CSV_SCHEMA.names[1:]])


def vote_line(row, rest):
    return f"{row},1,2,1A,teacher,{rest}"


def test_csv_of_the_export_format(spark, tmp_path):
    lines = [
        HEADER,
        vote_line(1, 'Evident,complete,3,4,"Oak, North","said ""yes""",5,"a, b",f01,text ,6'),
        vote_line(2, "Not Evident,,,,,,,,,,"),
        vote_line(3, ",NA,NA,NA,NA,NA,NA,NA,NA,NA,NA"),
    ]
    path = tmp_path / "votes.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = read_csv(spark, str(path)).orderBy("_c0").collect()
    assert [r._c0 for r in rows] == [1, 2, 3]
    assert rows[0].schoolname == "Oak, North"
    assert rows[0].eventname == 'said "yes"'
    assert rows[0].subtext == "text "
    assert rows[1].value == "Not Evident" and rows[1].districtId is None
    assert rows[2].value is None and rows[2].name is None
    scored = score_votes(read_csv(spark, str(path)), order=["_c0"], numbered=False)
    assert [(r.value, r.walkthroughid) for r in scored.collect()] == [("Evident", 5)]


def test_csv_round_trip(spark):
    df = spark.createDataFrame(
        [(1, 'comma, "quote"', None), (2, None, 1.5), (3, " padded ", -0.1),
         (4, "", 0.1), (5, "back\\slash\\", 1e300), (6, '"', 2.0), (7, "\ttab", 3.0)],
        "id long, text string, x double",
    )
    path = scratch_path(spark, "test")
    write_csv(df, path)
    assert sorted(read_csv(spark, path, df.schema).collect()) == sorted(df.collect())
    lines = df.withColumn("text", F.concat_ws("\n", "text", "text"))
    path = scratch_path(spark, "test")
    write_csv(lines, path)
    back = read_csv(spark, path, df.schema, multiline=True)
    assert sorted(back.collect()) == sorted(lines.collect())


def test_csv_row_numbers(spark):
    df = frame(spark, EDGE).select("identifier", "row")
    path = scratch_path(spark, "test")
    write_csv(df, path, row_numbers=["row"])
    schema = T.StructType([T.StructField("_c0", T.LongType()), *df.schema.fields])
    back = read_csv(spark, path, schema).collect()
    assert sorted((r._c0, r.row) for r in back) == [(i, i) for i in range(1, 18)]


def test_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('id,text\n1,"two\nlines"\n')
    df = read_csv(spark, str(path), T.StructType.fromDDL("id long, text string"), multiline=True)
    assert [tuple(r) for r in df.collect()] == [(1, "two\nlines")]


def test_csv_with_a_bad_number(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,text\n1,a\ntwo,b\n")
    schema = T.StructType.fromDDL("id long, text string")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(path), schema).collect()
    forgiving = read_csv(spark, str(path), schema, mode="PERMISSIVE")
    assert [tuple(r) for r in forgiving.collect()] == [(1, "a"), (None, "b")]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    schema = T.StructType.fromDDL("a long, b string")
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "one.csv").write_text('"",b,more,a\n1,x,m,7\n2,NA,m,8\n')
    rows = read_csv(spark, str(folder), schema)
    assert rows.schema == schema
    assert sorted(map(tuple, rows.collect())) == [(7, "x"), (8, None)]
    assert sorted(r.a for r in rows.select("a").collect()) == [7, 8]
    with pytest.raises(ValueError, match="no column c"):
        read_csv(spark, str(folder), T.StructType.fromDDL("a long, c string"))
    (folder / "two.csv").write_text('a,b,more,c\n7,x,m,1\n')
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(folder), schema).collect()


def test_csv_without_rows(spark):
    empty = spark.createDataFrame([], "a long, b string")
    path = scratch_path(spark, "test")
    write_csv(empty, path)
    assert read_csv(spark, path, empty.schema).collect() == []


def field(identifier, value, name="f01", **more):
    return {"identifier": identifier, "name": name, "subtext": "q", "value": value, **more}


def form(walkthrough, role, sections, **more):
    return {
        "eventId": 1, "classroomId": 2, "participantId": walkthrough,
        "participantRole": role, "status": "complete", "districtId": 3, "schoolid": 4,
        "schoolname": "Oak", "eventname": "Visit 1/2", "walkthroughid": walkthrough,
        PAYLOAD_COLUMN: sections if isinstance(sections, str) else json.dumps(sections),
        **more,
    }


FORMS = [
    form(10, "teacher", [
        {"focusGroup": "a", "fields": [
            field("1A", E, imageUpload={"show": True}), field("1B", "")]},
        {"focusGroup": "b", "fields": []},
    ]),
    form(11, "el coach", [{"focusGroup": "a", "fields": [field("1A", S), field("1B", N)]}]),
    form(12, "principal", []),
]


def test_json_array_of_forms(spark, tmp_path):
    path = tmp_path / "forms.json"
    path.write_text(json.dumps(FORMS, indent=1))
    forms = read_json(spark, str(path), array=True)
    assert forms.schema == FORM_SCHEMA
    flat = flatten_forms(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA)
    assert PAYLOAD_COLUMN not in flat.columns
    found = flat.select("walkthroughid", "focusGroup", "identifier", "`imageUpload.show`")
    assert sorted(map(tuple, found.collect()), key=str) == [
        (10, "a", "1A", True), (10, "a", "1B", None),
        (11, "a", "1A", None), (11, "a", "1B", None),
    ]
    scored = score_forms(forms).orderBy("group_index").collect()
    assert [(r.group_index, r.identifier, r.value, r.participantRole) for r in scored] == [
        (1, "1A", S, "el coach"), (2, "1B", N, "el coach")
    ]


def test_json_lines_round_trip(spark):
    df = spark.createDataFrame([(1, "é\n", None), (2, None, 0.1)], "a long, b string, c double")
    path = scratch_path(spark, "test")
    write_json(df, path)
    assert sorted(read_json(spark, path, df.schema).collect()) == sorted(df.collect())


def test_packed_json_round_trip_in_small_files(spark, tmp_path, monkeypatch):
    """A packed file is read by one task, so none may hold all records of a large task."""
    monkeypatch.setattr(files, "_PACKED_RECORDS", 50)
    df = spark.range(0, 1000, 1, 2).selectExpr(
        "id", "if(id % 7 = 0, null, concat('é\n', id)) text", "id / 3 share"
    )
    write_json(df, str(tmp_path / "plain"))
    write_json(df, str(tmp_path / "packed"), packed=True)
    size = {d: sum(f.stat().st_size for f in (tmp_path / d).glob("part-*")) for d in
            ("plain", "packed")}
    assert size["packed"] * 2 < size["plain"]
    parts = list((tmp_path / "packed").glob("part-*"))
    assert len(parts) == 20
    for part in parts:
        with gzip.open(part) as lines:
            assert len(list(lines)) == 50
    back = read_json(spark, str(tmp_path / "packed"), df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    none = df.filter("id < 0")
    write_json(none, str(tmp_path / "packed"), packed=True)
    assert read_json(spark, str(tmp_path / "packed"), df.schema).collect() == []


BAD = [form(13, "teacher", '[{"focusGroup": "a", "fields": ['),
       form(14, "teacher", '[{"focusGroup": "a", "fields": "none"}]'),
       form(16, "teacher", "[] and more"), form(17, "teacher", "[]} {"),
       form(18, "teacher", ""), form(19, "teacher", "{}"),
       form(20, "teacher", '[],"x":1'),
       form(21, "teacher", '[],"_body":[{"focusGroup":"INJ","fields":[]}]'),
       form(22, "teacher", '[],"_end":true} {"x":1'), form(23, "teacher", "[],[]")]


@pytest.mark.parametrize("bad", BAD)
def test_malformed_payload_fails(spark, bad):
    forms = spark.createDataFrame([*FORMS, bad], FORM_SCHEMA)
    with pytest.raises(Exception, match="(?i)malformed"):
        parse_json(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA).collect()


def test_malformed_payload_as_reject(spark):
    empty = form(15, "teacher", "[]", **{PAYLOAD_COLUMN: None})
    forms = spark.createDataFrame([*FORMS, *BAD, empty], FORM_SCHEMA)
    good, rejects = split_json_rejects(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA)
    assert sorted(r.walkthroughid for r in rejects.collect()) == [13, 14, *range(16, 24)]
    assert rejects.schema == forms.schema
    assert sorted(r.walkthroughid for r in good.collect()) == [10, 11, 12, 15]
    strict = parse_json(
        spark.createDataFrame(FORMS, FORM_SCHEMA), PAYLOAD_COLUMN, SECTIONS_SCHEMA
    )
    same = good.filter("walkthroughid < 15").orderBy("walkthroughid").collect()
    assert same == strict.orderBy("walkthroughid").collect()


def test_payload_is_parsed_once(spark):
    forms = spark.createDataFrame(FORMS, FORM_SCHEMA)
    flat = flatten_forms(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA).filter("value <> ''")
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_forms_to_report(spark, tmp_path):
    path = tmp_path / "forms.json"
    path.write_text(json.dumps(FORMS))
    votes = flatten_forms(
        read_json(spark, str(path), array=True), PAYLOAD_COLUMN, SECTIONS_SCHEMA
    )
    run = score_and_publish(votes, "clean_forms", check=True, seed=605, n=1)
    assert run.summary.first().ties == 1 and run.audit.clean.count() == 1
    one = lookup(run.clean, schoolname="Oak", eventname="Visit 1/2")
    report = crosstab(one, "subtext", "value", (E, S, N)).collect()
    assert [tuple(r) for r in report] == [("q", 0, 1, 1, 0, 0)]
    out = scratch_path(spark, "test")
    write_csv(run.clean, out, row_numbers=["group_index"])
    schema = T.StructType([T.StructField("_c0", T.LongType()), *run.clean.schema.fields])
    back = read_csv(spark, out, schema)
    assert sorted(back.drop("_c0").collect()) == sorted(run.clean.collect())


def test_unnest_drops_empty_and_null(spark):
    df = spark.createDataFrame(
        [(1, [(1, "a"), (2, "b")]), (2, []), (3, None)],
        "id int, items array<struct<n: int, s: string>>",
    )
    assert sorted(map(tuple, unnest(df, "items").collect())) == [(1, 1, "a"), (1, 2, "b")]
    with pytest.raises(ValueError, match="repeat"):
        unnest(df.withColumn("n", F.lit(1)), "items")
    with pytest.raises(ValueError, match="array of structs"):
        unnest(df, "id")


def test_flatten_structs_at_any_depth(spark):
    df = spark.createDataFrame(
        [(1, ("x", (True, None)))], "id int, a struct<b: string, c: struct<d: boolean, e: int>>"
    )
    flat = flatten_structs(df)
    assert flat.columns == ["id", "a.b", "a.c.d", "a.c.e"]
    assert tuple(flat.first()) == (1, "x", True, None)
    assert flatten_structs(flat, "_").columns == flat.columns


def test_table_and_view(spark):
    df = frame(spark, EDGE)
    path = scratch_path(spark, "test")
    write_table(df, path)
    back = read_table(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert read_table(spark, path, schema=None).schema == df.schema
    assert publish(back, "published_votes") is back
    assert spark.table("published_votes").count() == len(EDGE)
    assert spark.sql("SELECT DISTINCT eventId FROM published_votes").count() == 5


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert LAYOUT.order == ("row",)


def test_saved_table_without_a_declared_column_is_refused(spark, tmp_path):
    write_table(spark.range(3).selectExpr("id as valu"), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="value"):
        read_table(spark, str(tmp_path / "t"), T.StructType([T.StructField("value", T.LongType())]))


def test_rejects_are_split_in_one_pass(spark):
    forms = spark.createDataFrame(FORMS, FORM_SCHEMA)
    good, rejects = split_json_rejects(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA)
    for df in (good, rejects):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "from_json" not in text
        # The folder of the other verdict is not read.
        assert re.search(r"PartitionFilters: \[[^\]]*_fine", text)
    assert good.count() + rejects.count() == forms.count()


# -- arrays of objects, quoted line breaks, inferred types -------------------------------


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "20")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


ODD = ['}{', '"},{"', "\\", "\\\\\"}", "[", "]]", "a\nb", "", "}" * 40, "é{", '\\"{', None, "x" * 500 + "}"]
ARRAY_SCHEMA = "id bigint, text string, inner struct<a: array<struct<b: string>>>"


def odd_records(n):
    return [
        {"id": i, "text": ODD[i % len(ODD)], "inner": {"a": [{"b": ODD[i % 7]}, {}] if i % 3 else []}}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [0, 1, 60])
def test_one_array_is_read_by_many_tasks(spark, small_splits, tmp_path, indent, size):
    records = odd_records(size)
    for name in ("one", "two"):
        (tmp_path / name).write_text(json.dumps(records, indent=indent, ensure_ascii=False) + "\n")
    df = read_json(spark, str(tmp_path), T._parse_datatype_string(ARRAY_SCHEMA), array=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
    whole = spark.read.schema(ARRAY_SCHEMA).option("multiLine", True).json(str(tmp_path))
    want = sorted(map(str, whole.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    assert sorted(map(str, df.collect())) == want and len(want) == 2 * size
    tasks = borders.pieces(spark, str(tmp_path / "one"), "}").rdd.getNumPartitions()
    assert tasks > 1 or size < 60


@pytest.mark.parametrize("text", [
    '[{"id": 1} {"id": 2}]', '[{"id": 1}, 7, {"id": 2}]', '[{"id": 1}', '{"id": 1}', '[{"id": 1}] x',
    '[{"id": "a"}]', '[{"id": 1}, null]', '[{"id": 1},]', "[{]",
])
def test_what_is_no_array_of_objects_fails(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path), T._parse_datatype_string("id bigint"), array=True).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, small_splits, tmp_path, end):
    cells = ["plain", '"a, b"', '"said ""yes"""', f'"two{end}lines"', f'"{end}{end}"', '""', "NA", "",
             f'"x""{end}""y,"', '"' + "long, " * 100 + '"']
    lines = ["id,text,n"] + [f"{i},{cells[i % len(cells)]},{i / 4}" for i in range(200)]
    for name in ("one.csv", "two.csv"):
        (tmp_path / name).write_bytes((end.join(lines) + end).encode())
    schema = T._parse_datatype_string("id bigint, text string, n double")
    df = read_csv(spark, str(tmp_path), schema, multiline=True)
    whole = spark.read.schema(schema).options(header=True, nullValue="NA", quote='"', escape='"', multiLine=True)
    assert sorted(map(str, df.collect())) == sorted(map(str, whole.csv(str(tmp_path)).collect()))
    assert df.count() == 400
    assert borders.pieces(spark, str(tmp_path / "one.csv"), "\n").rdd.getNumPartitions() > 5
    (tmp_path / "three.csv").write_text("id,other,n\n1,a,2\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path), schema, multiline=True).collect()


def test_types_are_found_from_all_rows(spark, tmp_path):
    path = tmp_path / "typed.csv"
    rows = [f"{i},{i},{i}.5,TRUE,,a{i},{i},{'9' * 25},{i},T" for i in range(3000)]
    rows[1] = ",NA,1e3,F,NA,,NA,1, 7 ,5"
    rows[2999] = "2,2,2,false,,b,late,2,3,F"
    path.write_text(",i,d,l,blank,t,late,big,padded,mixed\n" + "\n".join(rows) + "\n")
    df = read_csv(spark, str(path), schema=None)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {
        "_c0": "bigint", "i": "bigint", "d": "double", "l": "boolean", "blank": "boolean",
        "t": "string", "late": "string", "big": "double", "padded": "bigint", "mixed": "string",
    }
    found = df.filter("d = 1000").first()
    assert (found._c0, found.i, found.l, found.blank, found.t, found.padded) == (None, None, False, None, None, 7)
    assert df.filter("late = 'late'").count() == 1 and df.count() == 3000


def test_types_of_the_edge_case_votes(spark, tmp_path):
    path = tmp_path / "edge.csv"
    lines = [HEADER] + [vote_line(i, f"Evident,,{i},4,\"Oak, North\",,5,\"a, b\",f01,text ,6") for i in (1, 2)]
    path.write_text("\n".join(lines) + "\n")
    kinds = {f.name: f.dataType for f in read_csv(spark, str(path), schema=None).schema.fields}
    declared = {f.name: f.dataType for f in CSV_SCHEMA.fields}
    blank = {"status", "eventname"}
    assert {k: v for k, v in kinds.items() if k not in blank} == {
        k: v for k, v in declared.items() if k not in blank
    }
    assert {kinds[k] for k in blank} == {T.BooleanType()}


def test_one_pass_tells_whole_texts_from_others(spark):
    """Flattening reads a text once, and accepts only one whole value."""
    good = form(11, "teacher", [{"focusGroup": '_end"\\ _body', "fields": [field("1A", E)]}])
    flat = flatten_forms(spark.createDataFrame([good], FORM_SCHEMA), PAYLOAD_COLUMN, SECTIONS_SCHEMA)
    text = flat._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 1 and "jsonObjectKeys" not in text
    assert [(r.focusGroup, r.value) for r in flat.collect()] == [('_end"\\ _body', E)]
    others = [r[PAYLOAD_COLUMN] for r in BAD] + [
        '[],"_end":null} {"x":1', "[],'_end':null}", '[],"\\u005fend":null} {"x":[', "[]}",
        '[],"_end":null', '[],"_body":null', '"_end"',
    ]
    for bad in others:
        forms = spark.createDataFrame([good, form(12, "teacher", bad)], FORM_SCHEMA)
        with pytest.raises(Exception, match="(?i)malformed"):
            flatten_forms(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA).collect()
        with pytest.raises(Exception, match="(?i)malformed"):
            parse_json(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA).collect()
    missing = form(13, "teacher", "", **{PAYLOAD_COLUMN: None})
    forms = spark.createDataFrame([good, missing], FORM_SCHEMA)
    assert flatten_forms(forms, PAYLOAD_COLUMN, SECTIONS_SCHEMA).count() == 1
