"""FASTA grammar, ids over files and splits, and pair output."""

import random

from nearkin.sources.fasta import read_fasta, write_pairs

CASES = [
    ([">a", "AC", "GT", ">b", "TT"], ["ACGT", "TT"]),
    ([">a", "AC", "", ">b", "TT", ""], ["AC", "TT"]),
    ([">a", "AC", "", "", ">b", "TT"], ["AC", "", "TT"]),
    (["", ">a", "AC"], ["", "AC"]),
    ([">a", "AC", ">b"], ["AC"]),
    (["AC", "GT"], ["ACGT"]),
    ([">a", ">b", "AC"], ["AC"]),
    (["AC", ">b", "GT", " ", "", "T"], ["AC", "GT ", "T"]),
    ([">a", "AC", "", ">b"], ["AC"]),
]


def records(spark, path, **kw):
    rows = read_fasta(spark, str(path), **kw).orderBy("seq_id").collect()
    assert [r.seq_id for r in rows] == list(range(len(rows)))
    return [r.seq for r in rows]


def test_grammar(spark, tmp_path):
    wanted = {}
    for at, (lines, expected) in enumerate(CASES):
        for kind, end in {"lf": "\n", "crlf": "\r\n"}.items():
            for closed in (True, False):
                # An unterminated empty last line is no line at all.
                name = f"{at}-{kind}-{closed}"
                text = end.join(lines) + (end if closed or lines[-1] == "" else "")
                (tmp_path / f"{name}.fas").write_bytes(text.encode())
                wanted[name] = expected
    for drop_empty in (False, True):
        heads = []
        for cut in ("header", "line"):
            found = {}
            rows = read_fasta(spark, str(tmp_path), layout="file", drop_empty=drop_empty, cut=cut).orderBy("sample", "seq_id").collect()
            for r in rows:
                assert r.seq_id == len(found.setdefault(r.sample, []))
                found[r.sample].append(r.seq)
            assert found == {n: [s for s in e if s or not drop_empty] for n, e in wanted.items()}
            heads.append([r.header for r in rows])
        assert heads[0] == heads[1]


def test_old_mac_line_ends(spark, tmp_path):
    path = tmp_path / "x.fas"
    path.write_bytes(b">a\rAC\r>b\rGT\r\rT\r")
    assert records(spark, path) == ["AC", "GT", "T"]


def test_names_order_and_reverse(spark, tmp_path):
    folder = tmp_path / "set.one"
    folder.mkdir()
    (folder / "b.x.fas").write_text(">1\nGG\n>2\nGC\n")
    (folder / "a.fas").write_text(">1\nAC\n")
    (folder / ".hidden.fas").write_text(">1\nTTTT\n")
    one = read_fasta(spark, str(folder)).orderBy("seq_id").collect()
    assert [(r.sample, r.seq_id, r.header, r.seq) for r in one] == [("set", 0, "1", "AC"), ("set", 1, "1", "GG"), ("set", 2, "2", "GC")]
    many = read_fasta(spark, str(folder), layout="file", reverse=True).orderBy("sample", "seq_id").collect()
    assert [(r.sample, r.seq_id, r.seq) for r in many] == [("a", 0, "CA"), ("b.x", 0, "GG"), ("b.x", 1, "CG")]
    nested = read_fasta(spark, str(tmp_path), layout="folder").orderBy("seq_id").collect()
    assert [(r.sample, r.seq) for r in nested] == [("set", "AC"), ("set", "GG"), ("set", "GC")]


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    seqs = ["ACGT"[i % 4] * (1 + i * 7 % 60) for i in range(500)]
    path = tmp_path / "big.fas"
    path.write_text("".join(f">r{i}\n{s}\n\n" for i, s in enumerate(seqs)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1000", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert records(spark, path) == seqs
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_do_not_depend_on_splits(spark, tmp_path):
    rng = random.Random(3)
    lines = [rng.choice(["", "", "A" * rng.randint(1, 30), "CG", "T" * 9, ">h" + str(n)]) for n in range(400)]
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.fas").write_text("\n".join(lines[:250]))
    (tmp_path / "mixed" / "b.fas").write_text("\n".join(lines[250:]) + "\n")
    (tmp_path / "bare").mkdir()
    seqs = ["ACGT"[i % 4] * (1 + i * 7 % 60) for i in range(300)]
    (tmp_path / "bare" / "one.fas").write_text("\n\n".join(s[:20] + "\n" * (len(s) > 20) + s[20:] for s in seqs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    wanted = {d: read_fasta(spark, str(tmp_path / "mixed"), drop_empty=d).orderBy("seq_id").collect() for d in (False, True)}
    assert len(wanted[False]) > len(wanted[True]) > 50
    try:
        for size in ("53", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for drop_empty, rows in wanted.items():
                assert read_fasta(spark, str(tmp_path / "mixed"), drop_empty=drop_empty, cut="line").orderBy("seq_id").collect() == rows
        assert records(spark, tmp_path / "bare" / "one.fas", cut="line") == seqs
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none.fas").write_text("")
    assert records(spark, tmp_path / "none.fas", cut="line") == []


def test_write_pairs(spark, tmp_path):
    out = str(tmp_path / "out")
    write_pairs(spark.createDataFrame([(0, 1), (0, 12)], "i int, j int"), out)
    write_pairs(spark.createDataFrame([(0, 1), (2, 12)], "i int, j int"), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["0 1", "2 12"]
    both = spark.createDataFrame([("s", "t", 3, 1)], "sample1 string, sample2 string, i int, j int")
    write_pairs(both, out)
    assert [tuple(r) for r in spark.read.text(out).collect()] == [("3 1", "s", "t")]
