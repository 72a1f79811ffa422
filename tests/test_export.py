"""One JSON document, templates by headers, and previews of mappings."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from coffer.sources import templates
from coffer.sources.export import export


def _pretty(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, separators=(",", " : "), ensure_ascii=False)


def test_the_document_is_that_of_a_plain_dump(spark, tmp_path):
    rows = [(k, f'n"{k}\\ é\n', k % 3 == 0, k / 4, dt.date(2024, 1, 1 + k % 28), None if k % 2 else f"m{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "id int, name string, `is it` boolean, price double, day date, memo string").repartition(7)
    other = spark.range(3).select("id", F.lit("2024-05-06 07:08:09").cast("timestamp").alias("at"))
    target = f"{tmp_path}/out.json"
    for _ in range(2):  # the second one replaces the first
        export(spark, {"zebra": (df, ["id"]), "apes": (other, ["id"])}, f"file://{target}", exportedAt="2024-01-01T00:00:00Z")
    plain = lambda r: {k: v for k, v in r.items() if v is not None}
    zebra = [plain(dict(id=r[0], name=r[1], **{"is it": r[2]}, price=int(r[3]) if r[3] == int(r[3]) else r[3], day=f"{r[4]}T00:00:00Z", memo=r[5])) for r in rows]
    apes = [dict(id=k, at="2024-05-06T07:08:09Z") for k in range(3)]
    assert open(target, encoding="utf-8").read() == _pretty({"zebra": zebra, "apes": apes, "exportedAt": "2024-01-01T00:00:00Z"})
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.json"]


def test_empty_tables_and_documents(spark, tmp_path):
    export(spark, {"a": (spark.range(0), ["id"])}, f"file://{tmp_path}/a.json")
    assert json.load(open(f"{tmp_path}/a.json")) == {"a": []}
    export(spark, {}, f"file://{tmp_path}/b.json")
    assert json.load(open(f"{tmp_path}/b.json")) == {}


_ROLES = ", ".join(f"{r} string" for r in templates.ROLES)


def test_templates_by_sets_of_headers(spark):
    mine = lambda *names: [*names, *[None] * (7 - len(names))]
    known = spark.createDataFrame([(1, 1, *mine("Date", "Text", "Sum"), "negative"), (2, 5, *mine("Sum", "Date", "Text"), "positive"), (3, 9, *mine("Date"), "negative"), (4, 9, *mine(), "negative")], f"template int, created int, {_ROLES}, sign string")
    files = [("a", ["Text", "Sum", "Date", "Sum"], "positive", 0.5), ("b", ["Date", "Text", "Sum"], "negative", 0.5), ("c", ["Date", "Text", "Sum", "More"], "negative", 0.5), ("d", [], "negative", 0.5), ("e", ["date"], "negative", 0.5), ("f", None, "negative", 0.5)]
    frame = spark.createDataFrame([(f, h, *mine("own"), s, c) for f, h, s, c in files], f"file string, headers array<string>, {_ROLES}, sign string, confidence double")
    got = {r.file: (r.template, r.date, r.sign, r.confidence) for r in templates.with_template(frame, known).collect()}
    assert got == {"a": (2, "Sum", "positive", 1.0), "b": (2, "Sum", "negative", 0.5), "c": (None, "own", "negative", 0.5), "d": (None, "own", "negative", 0.5), "e": (None, "own", "negative", 0.5), "f": (None, "own", "negative", 0.5)}
    more = spark.createDataFrame([(8, 7, *mine("Date"), "negative"), (9, 7, *mine("Date"), "positive"), (10, 8, *mine("Date"), "positive")], known.schema)
    assert sorted(r.template for r in templates.saved(known, more).collect()) == [1, 2, 3, 4, 10]


def test_previews(spark):
    rows = [("a", k, "2024-01-02", "-1.00" if k % 5 == 0 else "1.00", "x", "negative") for k in range(300)]
    rows += [("b", 1, "2024-01-02", "5", " ", "positive"), ("b", 2, "2024-01-02", "5", None, "positive"), ("c", 1, "never", "5", "x", "positive"), ("c", 2, None, None, None, None)]
    rows += [("d", 1, "2024-01-02", "5", "x", "positive"), ("d", 2, "2024-01-02", "-5", "x", "positive"), ("e", 1, "2024-01-02", "5", "x", "negative")]
    out = templates.previews(spark.createDataFrame(rows, "file string, row int, date string, amount string, merchant string, sign string"))
    got = {r.file: (r.sampled, r.parseable, r.usable, r.debits, r.missing, r.warnings) for r in out.collect()}
    assert got == {
        "a": (200, 200, 200, 40, 0, ["few_debits"]), "b": (2, 2, 0, 0, 2, ["nameless"]), "c": (2, 0, 0, 0, 0, ["unparseable"]), "d": (2, 2, 2, 1, 0, []), "e": (1, 1, 1, 0, 0, ["no_debits"]),
    }
