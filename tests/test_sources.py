import os

import pytest

from sessionmill.sources.logs import corrupt_lines, expand, ingest_count, read_events, read_lines
from sessionmill.sources.tail import Ledger, TailReader, counts, line_start, lines_ending, log_sizes, tail_events, tail_lines


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode if isinstance(text, str) else mode + "b") as f:
        f.write(text)


def test_tree(spark, tmp_path):
    write(f"{tmp_path}/project-a/s1.jsonl", '{"type":"user"}\n{"type":"assistant"}')
    write(f"{tmp_path}/project-a/s2.jsonl", '{"type":"user","sessionId":"other"}\n')
    write(f"{tmp_path}/x.json", '{"type":"user"}\n')
    write(f"{tmp_path}/x.JSONL", '{"type":"user"}\n')
    rows = read_events(spark, str(tmp_path)).collect()
    assert sorted((r.session_id, r.line_index) for r in rows) == [("other", 0), ("s1", 0), ("s1", 1)]
    assert all(r.observed_at is not None for r in rows) and ingest_count(spark, str(tmp_path)) == 3


def test_missing_root_is_empty(spark, tmp_path):
    assert read_events(spark, f"{tmp_path}/none").count() == 0


def test_line_numbers_and_bad_lines(spark, tmp_path):
    write(f"{tmp_path}/a.b.jsonl", b'{"type":"user"}\n\n{bad\n\xff{"type":"user"}\n{"type":"system"}\r\n')
    assert [(r.fallback_id, r.line_index) for r in read_lines(spark, str(tmp_path)).orderBy("line_index").collect()] == [("a.b", 0), ("a.b", 2), ("a.b", 4)]
    assert [r.line_index for r in read_lines(spark, str(tmp_path), "nonempty").orderBy("line_index").collect()] == [0, 1, 2]
    assert [r.event_type for r in read_events(spark, str(tmp_path)).orderBy("line_index").collect()] == ["user", "system"]
    assert [r.raw for r in corrupt_lines(spark, str(tmp_path)).collect()] == ["{bad"]


def test_a_bad_line_takes_no_other_with_it(spark, tmp_path):
    good = '{"type":"user","content":"� stands here"}\n'.encode()
    write(f"{tmp_path}/a.jsonl", good + b'{"type":"\xff"}\n' + good + b"\n" + good)
    assert sorted(r.line_index for r in read_lines(spark, str(tmp_path)).collect()) == [0, 2, 4]
    assert sorted(r.line_index for r in read_lines(spark, str(tmp_path), "nonempty").collect()) == [0, 1, 2]


def test_files_in_many_parts(spark, tmp_path):
    """Parts of 100 bytes that cut lines anywhere: each line once, under its own number."""
    want = {}
    for name, n in (("a", 300), ("b", 1), ("c", 57)):
        rows = [f'{{"n": {i}, "x": "{"é" * (i % 40)}"}}' if i % 7 else "" for i in range(n)]
        write(f"{tmp_path}/{name}.jsonl", "\n".join(rows) + "\n" * (n % 2))
        want |= {(name, i): r for i, r in enumerate(rows) if r}
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, "100")
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("source_path").rdd.getNumPartitions() >= 1
        assert {(r.fallback_id, r.line_index): r.raw for r in lines.collect()} == want and lines.count() == len(want)
        order = {}
        for name, i in sorted(want):
            order[(name, sum(1 for x in order if x[0] == name))] = want[(name, i)]
        assert {(r.fallback_id, r.line_index): r.raw for r in read_lines(spark, str(tmp_path), "nonempty").collect()} == order
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_tilde(monkeypatch):
    monkeypatch.setenv("HOME", "/home/test")
    assert [expand(p) for p in ("~/x", "~", "/abs", "rel")] == ["/home/test/x", "/home/test", "/abs", "rel"]


def test_sizes_and_lines_by_their_ends(tmp_path):
    path = f"{tmp_path}/p/a.jsonl"
    write(path, "one\n\n two\nrest")
    write(f"{tmp_path}/b.txt", "x")
    write(f"{tmp_path}/c.JSONL", "x")
    assert log_sizes(str(tmp_path)) == {path: 14} and log_sizes(f"{tmp_path}/none") == {}
    for cut in range(15):
        assert [*lines_ending(path, 0, cut), *lines_ending(path, cut, 14)] == [b"one\n", b"\n", b" two\n"]
    with open(path, "rb") as f:
        assert [line_start(f, at) for at in range(15)] == [0] * 4 + [4] + [5] * 5 + [10] * 5
    assert [counts(x) for x in (b"a\n", b" \t\r\n", "\u2028\n".encode(), b"\x1c\n", b"\xff\n", "é\n".encode())] == [True, False, False, False, True, True]


def test_line_starts_far_back(tmp_path):
    path = f"{tmp_path}/a.jsonl"
    write(path, "x\n" + "y" * 300_000 + "\nz\n")
    with open(path, "rb") as f:
        assert line_start(f, 300_000) == 2 and line_start(f, 300_003) == 300_003
    assert [len(x) for x in lines_ending(path, 250_000, 400_000)] == [300_001, 2]


def batches(root, ledger=None, most=1 << 20, part=1 << 20, starting="earliest"):
    """Offsets and rows of a reader, batch after batch, without Spark; `grow` is called between them."""
    reader = TailReader({"path": str(root), "startingOffsets": starting, "maxBytes": str(most), "partBytes": str(part), "ledger": str(ledger or "")})
    at = reader.initialOffset()

    def step():
        nonlocal at
        new = reader.latestOffset()
        rows = [row[2:5] for p in reader.partitions(at, new) for row in reader.read(p)]
        at = new
        return rows

    return step


@pytest.mark.parametrize("ledger", [True, False])
@pytest.mark.parametrize("most,part", [(1 << 20, 1 << 20), (7, 3), (1, 1), (64, 5)])
def test_any_cut_gives_the_same_lines(tmp_path, ledger, most, part):
    lines = [b'{"a":1}\n', b"\n", b" \r\n", "é\n".encode(), b"\xff\xfe\n", b"x" * 40 + b"\n", b"{bad}\r\n", "\u00a0\n".encode(), b"last\n"]
    path = f"{tmp_path}/logs/a.jsonl"
    write(path, b"".join(lines[:4]) + lines[4][:1])
    step = batches(f"{tmp_path}/logs", tmp_path / "ledger" if ledger else None, most, part)
    got = [row for _ in range(30) for row in step()]
    write(path, lines[4][1:] + b"".join(lines[5:]) + b"no end", "a")
    got += [row for _ in range(120) for row in step()]
    assert got == [(0, 0, '{"a":1}\n'), (0, 1, "é\n"), (0, 3, "x" * 40 + "\n"), (0, 4, "{bad}\r\n"), (0, 5, "last\n")]
    write(path, "new\n")
    assert [row for _ in range(5) for row in step()] == [(1, 0, "new\n")]


def test_the_driver_opens_no_log(tmp_path, monkeypatch):
    write(f"{tmp_path}/a.jsonl", "1\n2\n")

    def no(*args, **more):
        raise AssertionError("opened a file")

    monkeypatch.setattr("builtins.open", no)
    for starting in ("earliest", "latest"):
        reader = TailReader({"path": str(tmp_path), "startingOffsets": starting})
        start, end = reader.initialOffset(), reader.latestOffset()
        assert end == {f"{tmp_path}/a.jsonl": [4, 0]} and start == ({} if starting == "earliest" else end)
        assert len(reader.partitions(start, end)) == 1


def test_ledger_saves_counting_and_may_be_lost(tmp_path, monkeypatch):
    path, folder = f"{tmp_path}/logs/a.jsonl", f"{tmp_path}/ledger"
    step = batches(f"{tmp_path}/logs", folder)
    read = []
    real = lines_ending
    monkeypatch.setattr("sessionmill.sources.tail.lines_ending", lambda p, a, b: (read.append(b - a), real(p, a, b))[1])
    for i in range(20):
        write(path, f"line {i}\n" * 100, "a")
        assert [n for _, n, _ in step()] == list(range(100 * i, 100 * i + 100))
    assert sum(read) == os.path.getsize(path)  # nothing was read twice
    assert len(Ledger(folder, path, 0).known()) == 2
    for d, _, names in os.walk(folder):
        for n in names:
            os.remove(f"{d}/{n}")
    write(path, "more\n", "a")
    assert [n for _, n, _ in step()] == [2000]


def test_parts_of_a_batch_are_tasks_of_their_own(spark, tmp_path):
    write(f"{tmp_path}/logs/a.jsonl", "".join(f'{{"n":{i}}}\n' for i in range(3000)))
    lines = tail_lines(spark, f"{tmp_path}/logs", part_bytes=1000, ledger=f"{tmp_path}/ledger")
    q = lines.selectExpr("*", "spark_partition_id() as part").writeStream.format("memory").queryName("parts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("parts").orderBy("line_index").collect()
    assert [r.line_index for r in rows] == list(range(3000)) and all(f":{r.line_index}}}" in r.raw for r in rows)
    assert len({r.part for r in rows}) > 20


@pytest.fixture
def tail(spark, tmp_path):
    """Start a query over a tree; returns a function that gives the events seen so far."""
    running = []

    def start(root, starting="earliest"):
        name = f"tail{len(running)}_{os.getpid()}_{abs(hash(str(tmp_path)))}"
        rows = tail_events(spark, str(root), starting).select("session_id", "line_index", "source_path", "summary")
        q = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp{len(running)}").start()
        running.append(q)

        def seen():
            q.processAllAvailable()
            return sorted((r.session_id, r.line_index, "#" in r.source_path) for r in spark.table(name).collect())

        return seen

    yield start
    for q in running:
        q.stop()


def test_tail(spark, tail, tmp_path):
    root = tmp_path / "logs"
    path = f"{root}/p/s.jsonl"
    write(path, '{"type":"user"}\n\n{bad}\n{"type":"user"}\n{"type":"us')
    seen = tail(root)
    assert seen() == [("s", 0, False), ("s", 2, False)]
    write(path, 'er","sessionId":"r"}\n', "a")
    assert seen()[0] == ("r", 3, False)
    write(path, '{"type":"system"}\n')  # shorter: a new generation
    assert ("s", 0, True) in seen() and len(seen()) == 4


def test_tail_from_the_end(spark, tail, tmp_path):
    root = tmp_path / "logs"
    write(f"{root}/s.jsonl", '{"type":"user"}\n\n{"type":"user"}\n')
    seen = tail(root, "latest")
    assert seen() == []
    write(f"{root}/s.jsonl", '{"type":"user"}\n', "a")
    write(f"{root}/t.jsonl", '{"type":"user"}\n')
    assert seen() == [("s", 2, False), ("t", 0, False)]
