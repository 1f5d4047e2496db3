"""Tab-separated files in splits of any size against Python's own reader of the whole file."""

import csv
import io
import random

import pytest

from passagework import schemas
from passagework.operators.ingest import unpivot_links
from passagework.session import new_path
from passagework.sources import readers, tsv


def write(spark, texts):
    """Files named in order; returns their folder."""
    path = new_path(spark, "tsv")
    import pathlib

    folder = pathlib.Path(path.removeprefix("file:"))
    folder.mkdir(parents=True)
    for i, text in enumerate(texts):
        (folder / f"part-{i:03}.tsv").write_bytes(text.encode())
    return str(folder)


def plain(texts, columns):
    """All records after each header, numbered; by the csv module."""
    out = []
    for text in texts:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t") if r]
        if rows:
            places = [rows[0].index(c) if c in rows[0] else None for c in columns]
            for r in rows[1:]:
                out.append(tuple((r[p] or None) if p is not None and p < len(r) else None for p in places))
    return [(i, *r) for i, r in enumerate(out)]


@pytest.fixture
def split_bytes(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield put
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def random_file(seed, names, rows):
    r = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    writer.writerow(names)
    for _ in range(rows):
        writer.writerow([r.choice(["", "plain", "a b", 'qu"ote', "two\nlines", "\n\n", "tab\there", '"', '""\n"', "é𝔘", "x" * r.randint(0, 80)]) for _ in names])
        if r.random() < 0.1:
            out.write("\n")  # a blank line is no record
    return out.getvalue()


@pytest.mark.parametrize("size", [7, 40, 333, 1 << 20])
def test_any_split_gives_the_same_rows(spark, split_bytes, size):
    split_bytes(size)
    texts = [random_file(1, ["b", "other", "a"], 60), random_file(2, ["a", "b"], 25), "", "a\tb\n", random_file(3, ["a", "more", "b", "c\nd"], 12).rstrip("\n")]
    found = tsv.read_records(spark, write(spark, texts), ["a", "b", "missing"])
    assert found.columns == ["row_number", "a", "b"]
    assert sorted(map(tuple, found.collect())) == plain(texts, ["a", "b"])


def test_facts_that_are_shuffled(spark, split_bytes, monkeypatch):
    split_bytes(60)
    monkeypatch.setattr(tsv, "SENT_BYTES", 0)
    texts = [random_file(5, ["a", "b"], 50), random_file(6, ["b", "a"], 50)]
    assert sorted(map(tuple, tsv.read_records(spark, write(spark, texts), ["a", "b"]).collect())) == plain(texts, ["a", "b"])


@pytest.mark.parametrize("line", ["a\tb", '"a\tb', 'a "b" c', '"a""b"\t"c', '"a"x"y\t"', '""', '"""', '\t"\t"\t"', 'x\t"y""'])
def test_state_after_a_line(line):
    """Inside exactly if the csv module would take the next line into the same record."""
    for begin, inside in (("", False), ('"', True)):
        records = list(csv.reader([begin + line + "\n", "zz\n"], delimiter="\t"))
        assert tsv.inside_after(line, inside) == (len(records) == 1)


def test_windows_line_ends_and_an_open_quote(spark, split_bytes):
    split_bytes(10)
    text = 'a\tb\r\n1\t"x\r\ny"\r\n\r\n2\t\r\n3\t"open\nto the end'
    rows = sorted(map(tuple, tsv.read_records(spark, write(spark, [text]), ["a", "b"]).collect()))
    assert rows == [(0, "1", "x\r\ny"), (1, "2", None), (2, "3", "open\nto the end")]


def test_questions_without_row_numbers(spark, split_bytes):
    split_bytes(30)
    names = [f.name for f in schemas.questions("wikipedia_link_", 2).fields][1:]
    texts = ["\t".join(["Prompt", *names]) + "\n" + "".join(f'"long\nprompt {i}"\tu{i}\t{"" if i % 2 else f"v{i}"}\n' for i in range(20))] * 2
    questions = readers.read_questions_tsv(spark, write(spark, texts), "wikipedia_link_", 2)
    assert questions.columns == ["q_id", *names]
    links = sorted(map(tuple, unpivot_links(questions, prefix="wikipedia_link_", count=2).collect()))
    assert links == sorted((20 * f + i, slot, f"{'uv'[slot - 1]}{i}") for f in (0, 1) for i in range(20) for slot in (1, 2) if slot == 1 or i % 2 == 0)


def test_no_rows(spark):
    path = write(spark, ["", "a\tb\n", "\n\n"])
    assert tsv.read_records(spark, path, ["a", "b"]).count() == 0
    assert readers.read_questions_tsv(spark, path, "x", 1).columns == ["q_id"]
