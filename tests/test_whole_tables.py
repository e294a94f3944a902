import functools
import hashlib
import json
import os
import random
import re
import time

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from loomline import queries
from loomline.functions.patterns import KEY_VALUE, KINDS, NORMAL_NAMES, NORMAL_ORDER, SIMPLE
from loomline.operators import chunks, structure, templates
from loomline.session import cut
from loomline.sources.batches import pieces
from loomline.streaming import counts

LINES = ["plain user1234 k=v 5", "größe=10 é12 naïve=ja k=ü,b", "é2024-01-02T03:04:05 ١٢ x²7", "a b=1 c=2 http://x.de/ü z", "Straße /pfad/ä/b éuser_abcd12 12é req-abcd1é", "a@b.deé ünit@web.de 1.2.3.4é ²1.2.3.4"]


def tables(spark, folder):
    rows = [(i, t, len(t)) for i, t in enumerate(LINES)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "event_id long, event_type string, ts timestamp, props string").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")


def normal(line):
    out = re.sub(r"\s+", " ", line.strip(" ").lower())
    for k in NORMAL_ORDER:
        out = re.sub(KINDS[k], NORMAL_NAMES.get(k, f"<{k}>"), out)
    return out


def test_structure_queries_read_every_line(spark, tmp_path):
    tables(spark, tmp_path)
    counts = {r.file_id: r for r in queries.q_kind_counts(spark, str(tmp_path)).collect()}
    assert [[counts[i][f"n_{k}"] for k in KINDS] + [counts[i].n_kv] for i in range(len(LINES))] == [[len(list(re.finditer(p, t))) for p in [*KINDS.values(), KEY_VALUE]] for t in LINES]
    pairs = sorted((r.file_id, r.key, r.value) for r in queries.q_kv_pairs(spark, str(tmp_path)).collect())
    assert pairs == sorted((i, m[1].lower(), m[2]) for i, t in enumerate(LINES) for m in re.finditer(KEY_VALUE, t))
    assert {r.file_id: r.normal for r in queries.q_normalize(spark, str(tmp_path)).collect()} == {i: normal(t) for i, t in enumerate(LINES)}


def test_patterns_of_the_jvm_find_what_plain_ones_find(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 22))) for _ in range(3000)] + LINES + ["", "  two\t\u2003blanks  ", "no variables, well-known"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", structure.normalized(F.col("line")).alias("normal"), templates.parts_of(F.col("line")).alias("parts"), templates.values_of(F.col("line")).alias("vals"), *structure.kind_counts(F.col("line")))
    simple = re.compile(SIMPLE, re.ASCII)
    for r in rows.collect():
        line = lines[r.i]
        assert r.normal == normal(line)
        assert [r[f"n_{k}"] for k in KINDS] + [r.n_kv] == [len(re.findall(p, line)) for p in [*KINDS.values(), KEY_VALUE]]
        assert (r.parts, r.vals) == (simple.split(line), simple.findall(line))


def test_patterns_are_not_tried_on_plain_prose(spark):
    """A line that can't hold a kind is not searched for it: prose takes a fraction of the time of the patterns."""
    prose = "the quick brown fox jumps over the lazy dog and then walks home with nothing in its mind " * 40
    rows = cut(spark.range(3000).select(F.concat(F.lit(prose), F.translate(F.col("id").cast("string"), "0123456789", "ghijklmnop")).alias("line")))

    def took(*columns):
        times = []
        for _ in range(3):
            at = time.time()
            rows.select(*columns).write.format("noop").mode("overwrite").save()
            times.append(time.time() - at)
        return min(times)

    assert took(*structure.kind_counts(F.col("line"))) < took(*(F.regexp_count("line", F.lit(structure._unicode(p))) for p in KINDS.values())) / 2


def test_format_bytes_of_every_document(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 2048), (3, 1 << 20), (4, 3 << 30), (5, None)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    said = {r.doc_id: r.said for r in queries.q_format_bytes(spark, str(tmp_path)).collect()}
    assert said == {1: "5 B", 2: "2.0 KB", 3: "1.0 MB", 4: "3.00 GB", 5: "n/a"}


def test_sizes_are_said_as_printf_says_them(spark, tmp_path):
    rng = random.Random(5)
    sizes = [(540, 18009), (20, 2000), (1, 2000), (3, 2000), (7, 8), (1, 1 << 62), (0, 0), (5, 0), (9, 9), (-3, -7), (-10, -5), *((rng.randrange(6000), rng.randrange(1, 120_000)) for _ in range(20_000)), *((b * t // 2000, b) for t in range(1, 4000, 2) for b in (2000, 18_000, 64_000))]
    sizes += [(1 << 60, 3), (9_000_000_000_000_000_123, 7)]
    spark.createDataFrame([(i, 1, p, s) for i, (s, p) in enumerate(sizes)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")

    def want(s, p):
        if p == 0 or s == p:
            return "(baseline size is 0, delta not meaningful)" if p == 0 else "archive is equal in size to baseline."
        return f"archive is {abs(s - p):,} bytes ({abs(s - p) / p * 100:.1f}%) {'SMALLER' if s < p else 'LARGER'} than baseline."

    assert {r.l_orderkey: r.said for r in queries.q_format_delta(spark, str(tmp_path)).collect()} == {i: want(*x) for i, x in enumerate(sizes)}
    n = [1152, 1177, 1050, (5 << 30) + (5 << 30) // 8, (1 << 30) + (1 << 30) // 200, *(rng.randrange(1 << 36) for _ in range(5000)), *(rng.randrange(1 << 20) for _ in range(5000))]
    spark.createDataFrame(list(enumerate(n)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    said = lambda x: f"{x} B" if x < 1024 else f"{x / 1024:.1f} KB" if x < 1 << 20 else f"{x / (1 << 20):.1f} MB" if x < 1 << 30 else f"{x / (1 << 30):.2f} GB"
    assert {r.doc_id: r.said for r in queries.q_format_bytes(spark, str(tmp_path)).collect()} == {i: said(x) for i, x in enumerate(n)}


def test_sequential_deltas_look_past_64_deltas(spark, tmp_path):
    rng = random.Random(3)
    size = chunks.CHUNK
    far = "".join(rng.choice("abcdef") for _ in range(size))
    near = "".join(rng.choice("uvwxyz") for _ in range(size))
    texts = [far, near, *(f"{n:04d}" + near[4:] for n in range(70)), "0000" + far[4:]]
    spark.createDataFrame(list(enumerate(texts)), "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.chunk_id: r.base_id for r in queries.QUERIES["q_sequential_deltas"](spark, str(tmp_path)).collect()} == {**dict.fromkeys(range(2, 72), 1), 72: 0}


DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain_scan(line):
    """From the cursor, each kind searched for on its own; the earliest start wins, then the longer of key's value and kind."""
    parts, values, kinds, at = [], [], [], 0
    patterns = {k: re.compile(p) for k, p in KINDS.items()}
    while at < len(line):
        found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns.items()) if (m := p.search(line, at))]
        options = [(s, -e, 1, k) for s, _, k, e in sorted(found)[:1]]
        if m := re.compile(KEY_VALUE).search(line, at):
            options.append((m.start(2), -m.end(2), 0, "kv:" + m[1].lower()))
        if not options:
            break
        start, end, _, kind = min(options)
        parts, values, kinds, at = [*parts, line[at:start]], [*values, line[start:-end]], [*kinds, kind], -end
    return [*parts, line[at:]], values, kinds


BITS = [*"aZ_01 =\"'[]/.?&@:-+,;|<>\\é²中ſıİ٣\t\u00a0", "12", "2024-01-02", "03:04:05", "../", "c:", "http://", "https://", "k=", "x.de", "ab:cd:ef", "1.2.3.4", "0x1f", "deadbeefdeadbeef", "123e4567-e89b-12d3-a456-426614174000", "req", "request-id:", "TRACE", "user", "session", "[10/Oct/2000:13:55:36 -0700]", "e5"]


def test_scanner_tries_patterns_only_where_they_can_match():
    """Prose tries none, and the marks lose no match: as every kind alone finds them, and every kind replaced in turn."""
    assert structure._marks("Plain words, with a well-known stop. And another; très bien").kinds == []
    assert structure._marks("mail a@b.de now").kinds == ["email"]
    rng = random.Random(2)
    for _ in range(4000):
        line = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 22)))
        assert structure.scan_text(line) == plain_scan(line)
        assert structure.normalize(line) == plain_normal(line)


def test_lines_are_analysed_in_bounded_pieces(spark):
    """However large a batch of lines is, so many bytes of them at most are Python objects at once, and results keep their rows."""
    values = ["x" * n for n in (5, 900, 200, 1, 3000, 0, 0, 7)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(values)], ["id", "line"])
    cuts = list(pieces(batch, 1, 1000))
    assert [x for c in cuts for x in c.column(1).to_pylist()] == values
    assert all(c.num_rows == 1 or sum(len(x or "") for x in c.column(1).to_pylist()) <= 1000 for c in cuts) and len(cuts) == 4
    lines = [f"a{i % 7} k={i % 3} " + "word " * (i % 50) * 40 for i in range(3000)]
    found = structure.tokenize(spark.createDataFrame(list(enumerate(lines)), "line_index int, line string").coalesce(1), ["parts", "values"])
    assert found.columns == ["line_index", "line", "parts", "values"]
    assert all(r.line == lines[r.line_index] and (r.parts, r["values"]) == plain_scan(r.line)[:2] for r in found.collect())


def plain_leaves(value, path=()):
    if isinstance(value, dict) or (isinstance(value, list) and value):
        for k, v in value.items() if isinstance(value, dict) else (("[]", x) for x in value):
            yield from plain_leaves(v, (*path, k))
    elif not isinstance(value, list):
        yield path, "json_null" if value is None else "json_bool" if isinstance(value, bool) else "json_string" if isinstance(value, str) else "json_number"


def plain_normal(part):
    part = re.sub(r"\s+", " ", part.strip().lower())
    for k in NORMAL_ORDER:
        part = re.sub(KINDS[k], NORMAL_NAMES.get(k, f"<{k}>"), part)
    return part


def plain_analysis(line):
    """(parts, values, kinds, skeleton, is_json, json_key) as one string each."""
    try:
        whole = json.loads(line) if line.strip()[:1] in ("{", "[") and line.strip() else None
    except ValueError:
        whole = None
    if isinstance(whole, (dict, list)):
        leaves = list(plain_leaves(whole))
        key = sorted(f"{'.'.join(p)}={k}" for p, k in leaves)
        return None, None, [k for _, k in leaves], ["json", *key], True, key
    parts, values, kinds = plain_scan(line)
    normal = [plain_normal(p) for p in parts]
    return parts, values, kinds, [x for n, k in zip(normal, [*(f"<{k}>" for k in kinds), None], strict=True) for x in (n, k) if x is not None], False, []


@needs_data
def test_structure_of_every_line_against_a_plain_version(spark):
    sep, analysed = queries.SEP, functools.cache(plain_analysis)
    lines = {(r.corpus, r.file_id, r.line_index): r.line for r in queries.q_lines(spark, DATA).collect()}
    got = queries.q_v2_template(spark, DATA).collect()
    assert len(got) == len(lines) == 20_218
    per = {}
    for r in got:
        line = lines[r.corpus, r.file_id, r.line_index]
        parts, values, kinds, skeleton, is_json, key = analysed(line)
        assert (r.kinds, r.skeleton, r.is_json) == (sep.join(kinds), sep.join(skeleton), is_json)
        if not is_json:
            assert (r.parts, r.vals) == (sep.join(parts), sep.join(values))
        own = per.setdefault(r.corpus, [0, 0, set(), set(), {}])
        own[0] += 1
        own[1] += is_json
        if key:
            own[2].add(tuple(key))
        own[3].add(tuple(skeleton))
        own[4].setdefault(tuple(skeleton), set()).add(r.parts)
    metrics = {r.corpus: (r.num_lines, r.json_lines_detected, r.json_template_count, r.normalized_template_count) for r in queries.q_v2_metrics(spark, DATA).collect()}
    assert metrics == {c: (n, j, len(keys), len(skeletons)) for c, (n, j, keys, skeletons, _) in per.items()}
    merged = {r.corpus: (r.n_skeletons, r.n_templates, r.merged) for r in queries.q_fuzzy_merge(spark, DATA).collect()}
    assert merged == {c: (len(x[4]), sum(map(len, x[4].values())), sum(len(p) - 1 for p in x[4].values())) for c, x in per.items()}


@needs_data
def test_content_chunks_of_every_document_against_a_plain_version(spark):
    table = [int.from_bytes(hashlib.sha256(chunks.GEAR_SEED + bytes([i])).digest()[:8], "big") for i in range(256)]
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        data, at, seq = (r.text or "").encode(), 0, 0
        while at < len(data):
            end, h = min(at + chunks.CDC_MAX, len(data)), 0
            if len(data) - at > chunks.CDC_MIN:
                for i in range(at + chunks.CDC_MIN, end):
                    h = ((h << 1) + table[data[i]]) & (2**64 - 1)
                    if not h & chunks.CDC_MASK:
                        end = i + 1
                        break
            else:
                end = len(data)
            want.append((r.doc_id, seq, hashlib.sha256(data[at:end]).hexdigest(), end - at))
            at, seq = end, seq + 1
    assert sorted(tuple(r) for r in queries.q_cdc_chunks(spark, DATA).collect()) == sorted(want)


@needs_data
def test_compressed_sizes_of_every_document(spark):
    press = zstandard.ZstdCompressor(level=3)
    want = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.file_id: (r.raw, r.packed) for r in queries.q_zstd_sizes(spark, DATA).collect()}
    assert got == {i: (len(t), len(press.compress(t))) for i, t in want.items()}


@needs_data
def test_sequential_deltas_of_every_event_against_a_plain_version(spark):
    seen, whole, want = [], [], {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "props").orderBy("event_id").collect():
        data = (r.props or "").encode()
        if data and data not in seen:
            seen.append(data)
    for i, data in enumerate(seen):
        same = [(sum(a == b for a, b in zip(seen[j], data, strict=True)), j) for j in whole[-64:] if len(seen[j]) == len(data)]
        equal, j = max(same, default=(0, -1))
        diffs = [(n, b) for n, (a, b) in enumerate(zip(seen[j], data, strict=False)) if a != b]
        size = (1 if len(diffs) < 16 else 3) + sum(1 + (1 if n < 128 else 2) + (1 if b < 128 else 2) for n, b in diffs)
        if equal > int(0.8 * len(data)) and size < len(data):
            want[i] = (j, len(diffs))
        else:
            whole.append(i)
    assert {r.chunk_id: (r.base_id, r.n_diffs) for r in queries.q_sequential_deltas(spark, DATA).collect()} == want and want


def test_late_rows_of_closed_windows_are_dropped(spark, tmp_path):
    """A batch for each file: the last one's row is hours late, and its window closed two batches before."""
    schema = "ts timestamp, line string"
    for ts, line in [("2024-01-01 10:05:00", "a 1"), ("2024-01-01 12:30:00", "a 2"), ("2024-01-01 12:40:00", "a 4"), ("2024-01-01 10:10:00", "a 3")]:
        time.sleep(1.1)  # files are taken in order of their times
        spark.sql(f"select timestamp '{ts}' as ts, '{line}' as line").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = counts.drain(counts.windowed_templates(stream), f"{tmp_path}/out", counts.WINDOWED_KEYS).collect()
    assert sorted((r.window_start.hour, r.template, r.n) for r in got) == [(10, "a {}", 1), (12, "a {}", 2)]
    running = counts.drain(counts.stream_templates(stream), f"{tmp_path}/all", counts.KEYS).collect()
    assert [(r.template, r.n) for r in running] == [("a {}", 4)]
