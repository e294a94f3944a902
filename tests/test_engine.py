import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import codecs, scalar
from loomline.operators import chunks, columns, metrics, structure, templates
from loomline.operators.numbering import positions
from loomline.plans import archive
from loomline.session import cut, cut_dealt
from loomline.sources.corpora import directory, lines_of_files, lines_of_text

EDGES = ["", "a {} 5", "{} {} 7", "lone\rreturn 1", "crlf 5\r", "nul \0 byte 3", "-0 007 +1", "9" * 40, "123e4567-e89b-12d3-a456-426614174000@example.com x=1", 'k="a b" k2=[1 2] Z=\'q\'', '{"a":{},"b":1}', '{"a":1,"a":2}', "[]", '{"x":[1,"two",null,true,{"y":-1.5e3}]}', "request username path /a/b", "ümlaut é 12", "  spaced   out  4 "]


def lines(spark, values, file_id=1):
    return spark.createDataFrame([(file_id, i, v) for i, v in enumerate(values)], "file_id long, line_index int, line string")


@pytest.mark.parametrize("tokenizer", [templates, structure])
def test_every_line_is_rebuilt(spark, tokenizer):
    tokens = tokenizer.tokenize(lines(spark, EDGES * 2))
    dictionary = templates.template_dictionary(templates.template_counts(tokens))
    found = templates.records(tokens, dictionary)
    back = {r.line_index: r.line for r in templates.restored(found, dictionary).collect()}
    assert [back[i] for i in range(len(EDGES) * 2)] == EDGES * 2
    assert templates.integrity_errors(found, dictionary).count() == 0


def test_sequential_ranges_pass_through_workers(spark):
    """Ranges that share a partition keep their own bases, chunks come in order of ids, and no range is one group in memory."""
    rng = random.Random(9)
    base = bytes(rng.randrange(256) for _ in range(200))
    data = [bytes([i]) + base[1:] if i % 5 else bytes(rng.randrange(256) for _ in range(200)) for i in range(60)]
    rows = [(i, bytearray(x)) for i, x in enumerate(data)]
    rng.shuffle(rows)
    found = chunks.sequential_deltas(spark.createDataFrame(rows, "chunk_id long, data binary").repartition(3), 8)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want = {}
    for start in range(0, 60, 8):
        whole = []
        for i in range(start, min(start + 8, 60)):
            same = [(sum(a == b for a, b in zip(data[j], data[i], strict=True)), j) for j in whole]
            equal, j = max(same, default=(0, -1))
            if equal > 160:
                want[i] = (j, [(n, b) for n, (a, b) in enumerate(zip(data[j], data[i], strict=True)) if a != b])
            else:
                whole.append(i)
    assert {r.chunk_id: (r.base_id, [(d.off, d.byte) for d in r.diffs]) for r in found.collect()} == want and len(want) > 20


def test_hot_templates_stay_dealt(spark, monkeypatch):
    """A template that most lines have comes to no single task: neither where lines meet templates, nor where they are numbered."""
    monkeypatch.setattr(templates, "HOT_LINES", 500)
    monkeypatch.setattr(columns, "SPAN", 100)
    rows = [(i % 3, i, f"a {i}" if i % 10 else f"b{'x' * (i % 70)} {i}" if i % 20 else f"only {'y' * i}") for i in range(4000)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(kept, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        tokens = cut(templates.tokenize(spark.createDataFrame(rows, "file_id long, line_index int, line string").repartition(4)))
        dictionary = templates.template_dictionary(templates.template_counts(tokens))
        found = templates.records(tokens, dictionary)
        numbered = columns.numbered_rows(found)
        largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest(found) < 2000 and largest(templates.templated_lines(tokens, dictionary)) < 2000 and largest(numbered) < 2000
        assert sorted(tuple(r) for r in templates.restored(found, dictionary).collect()) == sorted(rows)
        hit = {(r.file_id, r.line_index) for r in templates.templated_lines(tokens, dictionary).collect()}
        raw = {(r.file_id, r.line_index) for r in templates.raw_lines(tokens, dictionary).collect()}
        assert raw == {(f, i) for f, i, line in rows if line.startswith("only")} and hit == {(f, i) for f, i, _ in rows} - raw
        per = {}
        for f, i, t in sorted((r.file_id, r.line_index, r.tpl_id) for r in found.collect() if r.tpl_id is not None):
            per.setdefault(t, []).append((f, i))
        assert {(r.tpl_id, r.row_no, r.file_id, r.line_index) for r in numbered.collect()} == {(t, n, f, i) for t, x in per.items() for n, (f, i) in enumerate(x)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_integrity_errors_are_found(spark):
    found = spark.createDataFrame([(1, 0, 5, ["x"], None), (1, 1, 0, ["x"], None), (1, 3, None, None, None)], "file_id long, line_index int, tpl_id long, values array<string>, line string")
    dictionary = spark.createDataFrame([(0, ["a", "b", "c"])], "tpl_id long, parts array<string>")
    assert sorted(r.error for r in templates.integrity_errors(found, dictionary).collect()) == ["gap or repeat in lines", "raw record without line", "unknown template", "wrong number of values"]


def test_templates_are_numbered_as_first_seen(spark):
    rows = lines(spark, ["b 1", "a 1", "a 2", "b 2", "c"]).union(lines(spark, ["a 3"], 0))
    got = {"".join(r.parts): r.tpl_id for r in templates.template_dictionary(templates.template_counts(templates.tokenize(rows))).collect()}
    assert got == {"a ": 0, "b ": 1}


def test_positions_over_partitions(spark):
    values = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert {r.v: r.at for r in positions(df, ["v"], "at").collect()} == {v: i for i, v in enumerate(sorted(values))}


def test_fallback_reasons(spark):
    low = ["text only " + "abc"[i % 3] * (i + 1) for i in range(95)] + ["ERROR code=500 user=1"] * 5
    rows = lines(spark, low, 1).union(lines(spark, ["one", "two"], 2)).union(lines(spark, ["ERROR code=500 user=9"] * 3, 3))
    tokens = templates.tokenize(rows)
    rates = templates.fallback_reason(templates.file_rates(templates.records(tokens, templates.template_dictionary(templates.template_counts(tokens)))))
    assert {r.file_id: r.reason for r in rates.collect()} == {1: "low_structure", 2: "no_templates", 3: None}


COLUMNS = {
    "delta_varint": [f"INFO seq={i}" for i in range(400)],
    "varint": [f"INFO seq={i if i % 2 == 0 else 10_000_000 - i}" for i in range(400)],
    "dictionary": [f"INFO url=https://e.x/{'ab'[i % 2]}" for i in range(300)],
    "rle": [f"INFO url=https://e.x/{'ab'[i // 120]}" for i in range(240)],
    "raw_msgpack": [f"INFO url=https://e.x/{random.Random(i).getrandbits(60)}" for i in range(200)],
}


@pytest.mark.parametrize("encoding", COLUMNS)
def test_encodings_are_chosen_and_decoded(spark, encoding):
    tokens = templates.tokenize(lines(spark, COLUMNS[encoding]))
    found = templates.records(tokens, templates.template_dictionary(templates.template_counts(tokens)))
    cells = columns.slots(columns.numbered_rows(found, block_rows=150))
    choice = columns.encoding_choice(columns.column_sizes(cells))
    assert encoding in {r.encoding for r in choice.collect()}
    want = sorted((r.block_id, r.slot, r.row_no, r.value) for r in cells.collect())
    assert sorted((r.block_id, r.slot, r.row_no, r.value) for r in columns.decoded(columns.encoded(cells, choice)).collect()) == want
    assert {r.block_id for r in cells.collect()} == set(range(-(-len(COLUMNS[encoding]) // 150)))


def test_integers_that_are_not_canonical_stay_text(spark):
    tokens = templates.tokenize(lines(spark, ["v 007", "v -0", "v " + "9" * 30] * 3))
    found = templates.records(tokens, templates.template_dictionary(templates.template_counts(tokens)))
    sizes = columns.column_sizes(columns.slots(columns.numbered_rows(found))).first()
    assert sizes.varint is None and sizes.delta_varint is None


def test_zigzag_and_varint_sizes(spark):
    values = [0, -1, 1, 63, 64, -65, 127, 128, 2**31, -(2**40), 2**61]
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("z", scalar.zigzag(F.col("v"))).withColumn("n", scalar.varint_size(F.col("z"))).withColumn("b", scalar.unzigzag(F.col("z"))).collect()
    assert all(r.b == r.v and r.n == max(1, -(-r.z.bit_length() // 7)) for r in rows)


def test_packed_string_sizes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 31, 32, 255, 256, 65535, 65536)], "n long").select(scalar.str_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == [1, 32, 34, 257, 259, 65538, 65541]


def test_scan_rules():
    assert structure.scan_text("user=42 at 10.0.0.1:80")[1:] == (["42", "10.0.0.1:80"], ["kv:user", "ipv4"])
    assert structure.scan_text("id 123e4567-e89b-12d3-a456-426614174000@example.com")[2][0] == "uuid"
    assert structure.scan_text("the request failed")[1:] == (["request"], ["id"])
    assert structure.scan_text('a="x y" b')[1] == ['"x y"']
    assert structure.scan_text("")[0] == [""]


def test_json_leaves():
    found = structure.json_leaves('{"a": [1, {"b": "x"}], "a": null, "c": {}}')
    assert [(".".join(p), raw, kind) for p, raw, _, _, kind in found] == [("a.[]", "1", "json_number"), ("a.[].b", '"x"', "json_string"), ("a", "null", "json_null")]
    assert structure.json_leaves("[" * 50_000 + "1" + "]" * 50_000)[0][1] == "1"
    for bad in ("{", "[1,]", '{"a" 1}', "[1] x", "[01]", "nul", ""):
        assert structure.json_leaves(bad) is None, bad
    assert structure.analyze("[]")["json_key"] == ["json_empty", "[]"]


def test_normalize_and_fuzzy_merge(spark):
    assert structure.normalize("  Host 10.0.0.1   took 5 ") == "host <ipv<num>> took <num>"  # numbers come last, also inside names
    merged = structure.fuzzy_merge(structure.tokenize(lines(spark, ["Job A1 done 5", "job a1  done 6", "other"]))).first()
    assert merged.merged >= 1


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "a" / "deep").mkdir(parents=True)
    (root / "a.log").write_text("".join(f"INFO seq={i} host=web-{i % 3}\n" for i in range(500)))
    (root / "a" / "deep" / "b.log").write_bytes(("\n".join(EDGES * 3)).encode())
    (root / "empty.txt").write_bytes(b"")
    (root / "one.bin").write_bytes(b"\xff\x42" * 700)
    (root / "json.log").write_text("".join(f'{{"ts": {i}, "level": "info"}}\n' for i in range(80)))
    (root / "prose.txt").write_text("nothing here repeats at all\nnot even once")
    return root


def test_directory_order_and_kinds(spark, tree):
    rows = directory(spark, str(tree)).orderBy("file_id").collect()
    assert [r.path for r in rows] == ["a/deep/b.log", "a.log", "empty.txt", "json.log", "one.bin", "prose.txt"]
    assert [r.path for r in rows if not r.is_text] == ["one.bin"]
    assert lines_of_files(directory(spark, str(tree))).filter("line_index = 0").count() == 5
    with pytest.raises(ValueError, match="Not a directory"):
        directory(spark, str(tree / "a.log"))


@pytest.mark.parametrize("structured", [True, False])
def test_template_archive_restores_exactly(spark, tree, tmp_path, structured):
    summary = archive.compress_templates(spark, str(tree), str(tmp_path / "out"), structured, block_rows=64)
    assert summary["layout"] == "columnar" and summary["num_files"] == 6 and summary["binary_files"] == 1
    assert summary["raw_tar_zstd_files"] == (6 if summary["mode"] == "raw" else 0)
    assert (tmp_path / "out" / "encoded_columns").exists() == (summary["mode"] == "columnar") and (tmp_path / "out" / "templates").exists() == (summary["mode"] != "raw")
    assert summary["tarzstd_size"] == len(archive.tar_zstd(directory(spark, str(tree))))
    assert archive.differences(spark, str(tree), str(tmp_path / "out")).count() == 0
    paths = archive.restore(spark, str(tmp_path / "out"), str(tmp_path / "back"))
    assert all((tmp_path / "back" / p).read_bytes() == (tree / p).read_bytes() for p in paths) and len(paths) == 6


@pytest.mark.parametrize(("chunking", "delta"), [("fixed", True), ("cdc", False)])
def test_chunk_archive_restores_exactly(spark, tree, tmp_path, chunking, delta):
    blob = random.Random(2).randbytes(20_000)
    (tree / "x1.bin").write_bytes(blob)
    changed = bytearray(blob)
    changed[5000] ^= 1
    (tree / "x2.bin").write_bytes(bytes(changed))
    archive.compress_chunks(spark, str(tree), str(tmp_path / "out"), chunking, delta)
    assert archive.differences(spark, str(tree), str(tmp_path / "out")).count() == 0
    if delta:
        assert spark.read.parquet(str(tmp_path / "out" / "chunk_deltas")).count() == 1


@pytest.mark.parametrize(("name", "mode"), [("a.log", "template"), ("empty.txt", "raw"), ("one.bin", "raw"), ("prose.txt", "raw"), ("a/deep/b.log", None)])
def test_single_files_as_templates_or_raw(spark, tree, tmp_path, name, mode):
    if name == "a.log":
        rng = random.Random(1)
        said = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(200)]
        (tree / name).write_text("".join(f"{rng.choice(said)} {rng.randrange(10)} {rng.choice('xyz')}\n" for _ in range(60_000)))
    summary = archive.compress_file(spark, str(tree / name), str(tmp_path / "out"))
    assert mode in (None, summary["mode"])
    assert (summary["mode"] == "template") == (tmp_path / "out" / "records").exists() != (tmp_path / "out" / "raw_files").exists()
    assert archive.differences(spark, str(tree / name), str(tmp_path / "out"), single=True).count() == 0
    assert archive.restore(spark, str(tmp_path / "out"), str(tmp_path / "back"), shared=False) == [(tree / name).name]
    with pytest.raises(ValueError, match="Not a file"):
        archive.compress_file(spark, str(tree), str(tmp_path / "x"))


def test_chunks_are_compressed_with_a_trained_dictionary(spark, tree, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(200)]
    for i in range(30):
        (tree / f"w{i}.txt").write_text(" ".join(rng.choice(words) for _ in range(1000)))
    summary = archive.compress_chunks(spark, str(tree), str(tmp_path / "out"), delta=True)
    assert summary["dictionary_bytes"] > 0 and archive.differences(spark, str(tree), str(tmp_path / "out")).count() == 0
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).selectExpr("max(octet_length(data))").first()[0] < 4096


def test_varint_codecs():
    values = np.array([0, 1, 127, 128, 300, 2**32, 2**62, 2**63 - 1])
    assert codecs.encode_varints(values[:5]) == bytes([0, 1, 127, 128, 1, 172, 2])
    assert codecs.decode_varints(codecs.encode_varints(values), len(values)).tolist() == values.tolist()
    both = np.concatenate([values, -values, [-(2**63)]])
    assert codecs.decode_signed(codecs.encode_signed(both), len(both)).tolist() == both.tolist()
    assert codecs.encode_varints(np.zeros(0)) == b"" and codecs.decode_varints(b"", 0).tolist() == []
    for wrong in (lambda: codecs.encode_varints([-1]), lambda: codecs.decode_varints(b"\x80", 1), lambda: codecs.decode_varints(b"\x01\x01", 1), lambda: codecs.decode_varints(b"\x80" * 10 + b"\x01", 1)):
        with pytest.raises(ValueError):
            wrong()


def test_encoders_at_the_size_of_a_block(spark):
    n = columns.BLOCK_ROWS
    kinds = {"raw_msgpack": "cast(id * 7919 as string) || 'x'", "varint": "cast(pmod(xxhash64(id), 9000000) as string)", "delta_varint": "cast(1700000000 + id * 3 as string)", "dictionary": "'word' || pmod(id * 31, 5000)", "rle": "'run' || floor(id / 1000)"}
    each = [spark.range(n).selectExpr("0L as tpl_id", "0L as block_id", f"{i} as slot", "id as row_no", f"{e} as value") for i, e in enumerate(kinds.values())]
    cells = cut(metrics.union_all(each))
    choice = columns.encoding_choice(columns.column_sizes(cells))
    assert [r.encoding for r in choice.orderBy("slot").collect()] == list(kinds)
    began = time.time()
    back = columns.decoded(columns.unpacked(cut(columns.packed(columns.encoded(cells, choice)))))
    assert back.count() == 5 * n and back.exceptAll(cells.select(*back.columns)).isEmpty()
    assert time.time() - began < 120


def test_unsafe_paths_and_unknown_archives(spark, tmp_path):
    for path in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError, match="unsafe"):
            archive.safe_path("/tmp/root", path)
    spark.createDataFrame([{"version": "9", "kind": "template"}]).write.parquet(str(tmp_path / "bad" / "manifest"))
    with pytest.raises(ValueError, match="not an archive of version"):
        archive.restored_files(spark, str(tmp_path / "bad"))
    spark.createDataFrame([{"version": "2", "kind": "other"}]).write.parquet(str(tmp_path / "kind" / "manifest"))
    spark.createDataFrame([], "version string, kind string").write.parquet(str(tmp_path / "short" / "manifest"))
    for name, what in (("kind", "known kind"), ("short", "empty"), ("none", "no manifest")):
        with pytest.raises(ValueError, match=what):
            archive.restored_files(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="unknown chunking"):
        archive.compress_chunks(spark, str(tmp_path), str(tmp_path / "y"), "other")


def brute_cuts(data, table, least, most, mask):
    out, at = [], 0
    while at < len(data):
        if len(data) - at <= least:
            return [*out, len(data)]
        end, h = min(at + most, len(data)), 0
        for i in range(at + least, end):
            h = ((h << 1) + int(table[data[i]])) & (2**64 - 1)
            if h & mask == 0:
                end = i + 1
                break
        out.append(end)
        at = end
    return out


@pytest.mark.parametrize("size", [0, 1, 64, 65, 5000])
def test_content_defined_cuts(size):
    table = chunks.gear_table(b"seed")
    data = random.Random(size).randbytes(size)
    assert chunks.cut_points(data, table, 64, 256, 63) == brute_cuts(data, table, 64, 256, 63)
    assert chunks.cut_points(data, table) == brute_cuts(data, table, chunks.CDC_MIN, chunks.CDC_MAX, chunks.CDC_MASK)


def test_best_base_against_brute_force(spark):
    rng = random.Random(9)
    base = rng.randbytes(64)
    data = []
    for i in range(150):
        x = bytearray(base if i % 3 else rng.randbytes(64))
        for _ in range(rng.randint(0, 20)):
            x[rng.randrange(64)] = rng.randrange(256)
        data.append(bytes(x))
    dictionary = spark.createDataFrame([(i, bytearray(x), len(x)) for i, x in enumerate(data)], "chunk_id long, data binary, length long")
    want = {}
    for a in range(len(data)):
        scores = [(sum(p == q for p, q in zip(data[a], data[b], strict=True)), b) for b in range(max(0, a - 64), a)]
        if scores and max(scores)[0] > int(0.8 * 64):
            want[a] = (max(scores)[1], max(scores)[0])
    assert {r.chunk_id: (r.base_id, r.matches) for r in chunks.best_bases(dictionary).collect()} == want
    deltas = chunks.sequential_deltas(dictionary)
    bases = {r.base_id for r in deltas.collect()}
    assert bases and not bases & {r.chunk_id for r in deltas.collect()}
    back = {r.chunk_id: bytes(r.data) for r in chunks.resolve_deltas(dictionary, deltas).collect()}
    assert all(back[i] == data[i] for i in back)


def test_tree_differences_and_roll_up(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, content string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, content string")
    assert {r.path: r.difference for r in metrics.tree_differences(a, b).collect()} == {"y": "changed", "z": "missing", "w": "extra"}
    results = spark.createDataFrame([("a", True, -5.0), ("b", True, -20.0), ("c", False, 30.0), ("d", True, -1.0)], "name string, structured boolean, delta_pct double")
    row = metrics.roll_up(results).first()
    assert (row.wins, row.losses, row.structured_losses, row.worst, row.passed) == (3, 1, 0, "c", True)


def test_lines_keep_what_follows_the_last_newline(spark):
    got = lines_of_text(spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "\n")], "file_id long, text string")).collect()
    assert sorted((r.file_id, r.line_index, r.line) for r in got) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (2, 0, ""), (3, 0, ""), (3, 1, "")]


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "file_id long, line_index int, line string")
    tokens = templates.tokenize(empty)
    assert templates.reuse_rate(templates.template_counts(tokens)).first().rate == 0.0
    assert templates.template_dictionary(templates.template_counts(tokens)).count() == 0


def test_registry_imports_without_a_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dealt_tables_stay_where_they_are(spark):
    dealt = cut_dealt(spark.range(1000).selectExpr("id % 50 as k", "id as x"), 6, "k", order=("k", "x"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    other = cut(spark.range(50).selectExpr("id as k", "id * 2 as y"))
    plan = dealt.join(other.hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    sums = dealt.groupBy("k").agg(F.sum("x").alias("s"))
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString() and sums.count() == 50
