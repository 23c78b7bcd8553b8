"""Written files are the same in every run, whatever the layout of the input, and survive a second commit."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from vacantia.llm import records, warc
from vacantia.llm.common import Committed, exact_borders
from vacantia.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.01"


def digests(folder):
    return {f: hashlib.sha256(open(f"{folder}/{f}", "rb").read()).hexdigest() for f in sorted(os.listdir(folder))}


def test_archives_and_records_are_the_same_in_every_run(spark, tmp_path):
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, files in enumerate((1, 9)):
        folders = [str(tmp_path / f"{name}{k}") for name in ("warc", "records")]
        warc.write_warc(pages.repartition(files), folders[0], roll_bytes=40_000, shards=6)
        records.write_records(docs.repartition(files, "lang"), folders[1], shards=6)
        seen.append([digests(f) for f in folders])
    assert seen[0] == seen[1]
    assert len(seen[0][0]) > 6 and len(seen[0][1]) == 12


@pytest.mark.parametrize("values", [
    list(range(1000)), [7] * 500 + list(range(500)), [None] * 50, [], [-(1 << 63), (1 << 63) - 1, 0, 1, 2, None],
    [10**15 + i for i in range(300)] + list(range(300)), [5]])
def test_borders_follow_from_the_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k long")
    borders = exact_borders(df, "k", 8)
    assert borders == exact_borders(df.repartition(5), "k", 8) == sorted(set(borders)) and len(borders) < 8
    known = sorted(v for v in values if v is not None)
    sizes = [sum(a <= v < b for v in known) for a, b in zip([-(1 << 63), *borders], [*borders, 1 << 63], strict=True)]
    ties = max((known.count(v) for v in set(known)), default=0)
    assert sum(sizes) == len(known) and max(sizes) <= len(known) / 8 * 1.3 + ties + 1


def test_a_second_commit_leaves_the_first_file(tmp_path):
    for _ in range(2):
        out = Committed(str(tmp_path), "a.bin")
        out.write(b"same")
        out.commit()
        assert os.listdir(tmp_path) == ["a.bin"]
    cut = Committed(str(tmp_path), "a.bin")
    cut.write(b"same")  # an attempt that ends before its commit
    assert (tmp_path / "a.bin").read_bytes() == b"same"
    other = Committed(str(tmp_path), "a.bin")
    other.write(b"something else")
    with pytest.raises(FileExistsError):
        other.commit()
    assert (tmp_path / "a.bin").read_bytes() == b"same"


def test_ids_equal_the_plain_call_on_a_whole_table(spark):
    enc = Encoder(default_path())
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select(F.coalesce("text", F.lit(""))).collect()]
    odd = ["", " ", "a ", " a", "don't.", "it's)", "x" * 500 + ",", " " + "y" * 300 + ".", "ª.", "<|endoftext|> a", "a\n b", "é,é"]
    assert enc.encode(texts + odd) == enc._whole(texts + odd)
