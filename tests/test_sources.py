"""Readers, writers and streams."""

import json
import zipfile

import pytest

from registra.sources import registers as S


def register_file(path, n=3, key="eu"):
    path.write_text(json.dumps({"meta": {"key": key, "count": n}, "rows": [{"name": f"n{k}", "cas": "50-00-0", "row": k, "low_risk": True} for k in range(n)]}))
    return str(path)


def test_json_register(spark, tmp_path):
    good = register_file(tmp_path / "a.json")
    rows = S.read_register(spark, good)
    assert [x.name for x in rows.orderBy("ordinal").collect()] == ["n0", "n1", "n2"]
    (tmp_path / "bad.json").write_text('{"meta": {}, "rows": []}')
    with pytest.raises(Exception, match="meta.key"):
        S.read_register(spark, str(tmp_path / "bad.json")).collect()
    assert S.load(spark, ["/no/such", good])[1] == "fallback" and S.load(spark, ["/no/such"])[1] == "unavailable"
    assert S.load(spark, [good], expected=100)[1] == "truncated" and S.load(spark, [good], sha256="0")[1] == "unavailable"
    sha = S.fingerprints(spark, good).first().sha256
    assert S.load(spark, [good], sha256=sha)[1] == "loaded"


def test_csv_zip_workbook(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name;x\n"caf\xe9 ""q""";1\n'.encode("cp1252"))
    assert S.read_csv(spark, str(tmp_path / "a.csv"), "windows-1252", sep=";").first().name == 'caf\xe9 "q"'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p.csv", 'a,"b\nc"\nd\n')
    assert [tuple(x) for x in S.read_zip_csv(spark, str(tmp_path / "a.zip"), "p.csv", 2).collect()] == [("a", "b\nc"), ("d", None)]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><t>val</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert [tuple(x) for x in S.read_workbook(spark, str(tmp_path / "w.xlsx"), 1, 2).collect()] == [("val", "7")]


def test_sniff(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"substance": " x ", "cas": ""}]}')
    (tmp_path / "b.csv").write_text("Active substance;CAS Number\ny;50-00-0\n")
    assert [tuple(x) for x in S.sniff(spark, str(tmp_path / "a.json")).collect()] == [("x", None)]
    assert [tuple(x) for x in S.sniff(spark, str(tmp_path / "b.csv")).collect()] == [("y", "50-00-0")]


def test_packs(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "name string, row long")
    S.write_pack(rows, str(tmp_path / "p"), "open")
    assert S.install_pack(spark, str(tmp_path / "p")).count() == 2
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "p" / "body"))
    with pytest.raises(ValueError):
        S.install_pack(spark, str(tmp_path / "p"))
    out = [S.guarded_refresh(rows, str(tmp_path / "r"), "1", n, apply) for n, apply in ((5, True), (1, False), (1, True))]
    assert out == ["too few rows", "dry run", "written"]
    assert json.loads(S.to_json_register(rows, "k"))["meta"] == {"key": "k", "count": 2}
    assert S.report_lines(rows, "T", ["name"]).count() == 6


def test_streams(spark, tmp_path):
    from registra.streaming import usage

    events = [(f"2024-01-01 00:00:0{k}", "error") for k in range(4)] + [("2024-01-02 00:00:00", "view"), ("2024-01-02 00:00:01", "bogus")]
    df = spark.createDataFrame(events, "ts string, name string").selectExpr("cast(ts as timestamp) ts", "name")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode, name, **trigger):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(**(trigger or {"availableNow": True})).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {(x.name, x.n) for x in run(usage.daily_counts(stream), "complete", "daily")} == {("error", 4), ("view", 1)}
    assert max(x.n for x in run(usage.error_bursts(stream), "complete", "bursts")) == 4
    kind = "scan_id long, read long, at_ms long, cas array<string>, names array<string>, conf double"
    data = [(1, 1, 0, ["a"], [], 50.0), (1, 2, 100, ["a", "b"], [], 60.0), (1, 3, 200, ["c"], ["x"], 99.0),
            (2, 1, 0, [], ["permethrin"], 10.0), (2, 2, 5, ["a"], ["cypermethrin"], 9.0), (2, 3, 6, None, None, 99.0), (2, 4, 9000, [], ["zinc"], 1.0)]
    for name, rows, want in (("one", data[:-1], {(1, 2, 2), (2, 1, 2)}), ("late", data, {(1, 2, 2), (2, 4, 1)})):
        reads = spark.createDataFrame(rows, kind)
        reads.coalesce(1).write.parquet(str(tmp_path / f"reads_{name}"))
        stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / f"reads_{name}"))
        assert {(x.scan_id, x.read, x.votes) for x in run(usage.live_votes(stream), "update", f"votes_{name}", once=True)} == want


def test_pack_folders(spark, tmp_path):
    root = str(tmp_path / "packs")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "name string, row long")
    assert S.packs(spark, root) == [] and not S.remove_pack(spark, root, "x")
    for name in ("canada", "australia"):
        S.write_pack(rows, f"{root}/{name}", "open")
    rows.write.mode("append").parquet(f"{root}/australia/body")
    assert S.packs(spark, root) == ["australia", "canada"] and list(S.restore_packs(spark, root)) == ["canada"]
    assert S.remove_pack(spark, root, "australia") and S.packs(spark, root) == ["canada"]


def test_fingerprints_of_files(spark, tmp_path):
    import hashlib

    raw = b"\x00bytes\r\n"
    (tmp_path / "f.bin").write_bytes(raw)
    x = S.fingerprints(spark, str(tmp_path / "f.bin")).first()
    assert (x.length, x.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert S.verified(spark, str(tmp_path / "f.bin"), x.sha256) and not S.verified(spark, str(tmp_path / "f.bin"), "0") and S.verified(spark, str(tmp_path / "f.bin"), None)
    assert S.load(spark, [str(tmp_path / "none.json"), str(tmp_path / "f.bin")])[1] == "unavailable"


def test_review_export(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "c", None, None), (1, "a", "", "ok", "fine")], "row long, name string, cas string, verdict string, note string")
    S.review_export(rows, str(tmp_path / "review"))
    back = spark.read.schema("row long, verdict string").json(str(tmp_path / "review"))
    assert sorted((x.row, x.verdict) for x in back.collect()) == [(1, "ok"), (2, None)]


def test_dictionary(spark, tmp_path):
    told = {"sections": {"s": {"categoryKind": "codes", "categories": {"F": {"i18nKey": "cat.f", "shapes": ["F.", "f"]}, "M": {"i18nKey": "cat.m", "transferredFrom": "t"}, "Q": "cat.q"}, "statusCodes": {"REV": {"i18nKey": "st.rev"}}},
                         "d": {"categoryKind": "descriptive", "statusExplanations": {"REV*": {"i18nKey": "ex.rev"}}}}}
    (tmp_path / "d.json").write_text(json.dumps(told, indent=1))
    got = {(x.section, x.kind, x.code): (x.key, x.transferred, x.shapes, x.descriptive) for x in S.dictionary(spark, str(tmp_path / "d.json")).collect()}
    assert got == {("s", "category", "F"): ("cat.f", False, ["F.", "f"], False), ("s", "category", "M"): ("cat.m", True, None, False), ("s", "category", "Q"): ("cat.q", False, None, False),
                   ("s", "status", "REV"): ("st.rev", False, None, False), ("d", "explanation", "REV*"): ("ex.rev", False, None, True)}


def test_shared_folder(spark, monkeypatch):
    """A cluster must name the folder; in one machine a temporary one does. Scratch tables go when they are released."""
    from types import SimpleNamespace

    from registra.plans import shared

    fake = lambda master, found: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: found), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared.shared_dir(fake(master, None))
        assert shared.shared_dir(fake(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared.shared_dir(fake("local[4]", None)).startswith("file:")
    before = shared.held()
    a, b = (shared.written(spark.range(n), "test") for n in (3, 4))
    assert len(shared.held()) == len(before) + 2 and a.count() == 3
    shared.release(spark, before, keep=(b.scratch_path,))
    assert shared.held() == [*before, b.scratch_path] and b.count() == 4
    shared.release(spark, before)
    assert shared.held() == before
