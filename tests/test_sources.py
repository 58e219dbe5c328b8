"""Sources: config / Likert dimensions, CSV header cleaning, question maps, encoding audit, store."""

import json
import os
import tempfile

from sondage.sources import files as SF
from sondage.sources.store import TableStore


def _tmp():
    return tempfile.mkdtemp(prefix="sondage-src-")


def test_config_dim(spark):
    p = os.path.join(_tmp(), "study.json")
    with open(p, "w") as f:
        json.dump({"TEN": ["a", "b"], "T2B": ["c"], "SKIP": ["id"], "column_pairs_dict": {"x": ["a", "c"]}}, f)
    got = sorted((r["role"], r["question"]) for r in SF.config_dim(spark, p).collect())
    assert got == [("SKIP", "id"), ("T2B", "c"), ("TEN", "a"), ("TEN", "b")]


def test_likert_dim_and_first_level(spark):
    from sondage.operators.clean import likert_lookup
    p = os.path.join(_tmp(), "levels.json")
    with open(p, "w") as f:
        json.dump({"level_1": ["Strongly disagree", "1"], "level_2": ["Disagree", "Meh"], "level_4": ["Meh"]}, f)
    lk = {r["label"]: r["level"] for r in likert_lookup(SF.likert_dim(spark, p)).collect()}
    assert lk["Meh"] == 2.0 and lk["1"] == 1.0


def test_csv_clean_headers(spark):
    d = _tmp()
    p = os.path.join(d, "raw.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write(" id ,name, ,drop me,score\n1,a,x,y,5\n2,b,x,y,7\n")
    out = SF.csv_clean(spark, p, {"name": "label"}, ["drop me"])
    assert out.columns == ["id", "label", "score"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [("1", "a", "5"), ("2", "b", "7")]


def test_select_all_columns(spark):
    p = os.path.join(_tmp(), "map.csv")
    with open(p, "w") as f:
        f.write("id,q,flag,col\n1,x,ALL,taste\n2,y,SOME,aroma\n3,z,ALL,foam\n")
    assert sorted(r[0] for r in SF.select_all_columns(spark, p).collect()) == ["foam", "taste"]


def test_encoding_audit(spark):
    d = _tmp()
    with open(os.path.join(d, "u.csv"), "wb") as f:
        f.write("crème,brûlée\n".encode("utf-8"))
    with open(os.path.join(d, "l.csv"), "wb") as f:
        f.write("crème,brûlée\n".encode("latin-1"))
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("﻿a,b\n".encode("utf-8"))
    got = {os.path.basename(r["path"]): r["encoding"] for r in SF.encoding_audit(spark, f"{d}/*.csv").collect()}
    assert got == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1", "b.csv": "UTF-8-SIG"}


def test_encoding_audit_cut_character(spark):
    d = _tmp()
    with open(os.path.join(d, "cut.csv"), "wb") as f:
        f.write(("a" * 4999 + "é").encode("utf-8"))  # byte 5000 splits the 2-byte character
    r = SF.encoding_audit(spark, f"{d}/*.csv").first()
    assert r["encoding"] == "UTF-8"


def test_store_roundtrip(spark):
    store = TableStore(spark, root=_tmp(), prefix="t_")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    store.save(df, "k1")
    assert store.load("k1").count() == 1 and store.load("missing") is None
    assert "k1" in store.list()
    store.delete("k1")
    assert "k1" not in store.list()


def test_csv_quotes_and_line_breaks(spark):
    p = os.path.join(_tmp(), "raw.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('id,"a ""q"" name"\n1,"he said ""hi"", ok"\n2,"two\nlines"\n')
    out = SF.csv_clean(spark, p, multiline=True)
    assert out.columns == ["id", 'a "q" name']
    assert [tuple(r) for r in out.orderBy("id").collect()] == [("1", 'he said "hi", ok'), ("2", "two\nlines")]
    got = SF.combine_files(spark, [p], {'a "q" name': "text"}, multiline=True).collect()
    assert sorted(r[0] for r in got) == ['he said "hi", ok', "two\nlines"]


def test_store_keeps_keys_and_saves_over_itself(spark):
    store = TableStore(spark, _tmp(), prefix="Own_")
    store.save(spark.range(3), "a-B")
    store.save(spark.range(5), "a_B")
    store.save(store.load("a-B").where("id > 0"), "a-B")
    assert store.list() == ["a-B", "a_B"]
    assert store.load("a-B").count() == 2 and store.load("a_B").count() == 5
    store.delete("a-B")
    assert store.list() == ["a_B"] and store.load("a-B") is None


def test_no_local_scratch_on_a_cluster():
    import pytest

    from sondage.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_encoding_audit_reads_whole_files(spark):
    d = _tmp()
    for name, data in {"a.csv": b"plain," * 2000 + "é".encode("latin-1"), "b.csv": ("é" * 6000).encode(),
                       "c.csv": b"\xef\xbb\xbfx", "d.csv": "x".encode("utf-16")}.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    got = {r["path"][-5:]: r["encoding"] for r in SF.encoding_audit(spark, d + "/*.csv").collect()}
    assert got == {"a.csv": "ISO-8859-1", "b.csv": "UTF-8", "c.csv": "UTF-8-SIG", "d.csv": "UTF-16"}


def test_maxdiff_malformed(spark):
    from sondage.operators import summarise as A
    df = spark.createDataFrame([("P", "a:M,b"), ("P", "c:L"), ("P", None)], "product string, md string")
    assert [tuple(r) for r in A.maxdiff_malformed(df, ["md"], ["product"]).collect()] == [("P", "md", 3, 1)]


def test_encoding_audit_of_every_kind(spark):
    """Over several splits; a character at a split, a long line, no last line end, an empty file."""
    d = _tmp()
    text = "crème,brûlée\n" * 3000
    planted = {"utf8": text.encode(), "utf8-no-end": text.strip().encode(), "sig": text.encode("utf-8-sig"), "sig-no-end": "a,é".encode("utf-8-sig"),
               "latin": text.encode("latin-1"), "windows": (text + "“quoted” – 5 €\n").encode("windows-1252"), "ascii": b"a,b\r\n" * 900,
               "u16": text.encode("utf-16"), "u16le": text.encode("utf-16-le"), "u16be": text.encode("utf-16-be"), "empty": b"", "sig-only": b"\xef\xbb\xbf",
               "long": "é".encode() * 200_000, "cut-off": "é".encode()[:1] + b"\n" + "é".encode()[1:], "late": text.encode() + b"\xe9\n", "ends": b"\n\n\n"}
    for name, content in planted.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(content)
    limit = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "4097")
    try:
        got = {os.path.basename(r["path"]): (r["n_bytes"], r["encoding"]) for r in SF.encoding_audit(spark, f"{d}/*").collect()}
    finally:
        spark.conf.set(limit, before)
    want = {"utf8": "UTF-8", "utf8-no-end": "UTF-8", "sig": "UTF-8-SIG", "sig-no-end": "UTF-8-SIG", "latin": "ISO-8859-1", "windows": "windows-1252",
            "ascii": "UTF-8", "u16": "UTF-16", "u16le": "UTF-16LE", "u16be": "UTF-16BE", "sig-only": "UTF-8-SIG", "long": "UTF-8",
            "cut-off": "ISO-8859-1", "late": "ISO-8859-1", "ends": "UTF-8"}
    assert got == {k: (len(planted[k]), e) for k, e in want.items()} and set(planted) - set(got) == {"empty"}
