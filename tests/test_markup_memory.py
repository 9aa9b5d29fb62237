"""Python holds few rows of a batch as objects, however many the batch has."""

import tracemalloc

import pyarrow as pa

from notewright.functions import markup


def test_strings():
    values = ["a", None, "", "é摘要", None, "x" * 1000]
    made = markup.strings(iter(values))
    made.validate(full=True)
    assert made.type == pa.string() and made.to_pylist() == values
    assert markup.strings([]).to_pylist() == [] and markup.strings([None]).to_pylist() == [None]


def test_regular_pages_are_not_held_twice():
    pages = pa.array(["<p>" + "摘要" * 2000 + "</p>"] * 500)
    whole = sum(len(markup.regular(p).encode()) for p in pages.to_pylist())
    tracemalloc.start()
    got = markup._regular.func(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [markup.regular(p) for p in pages.to_pylist()]
    assert peak < 1.3 * whole
