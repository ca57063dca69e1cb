"""Time in proportion to the input, on the inputs that such parsers fear: when they double, time less than trebles (2.5, and some for the clock)."""

import time

import pytest

from tessera.operators import exact

INPUTS = {
    "blanks": lambda n: " " * n, "blanks between": lambda n: "a" + " " * n + "b", "loose dots": lambda n: "a " * (n // 2), "one word": lambda n: "a" * n, "one name": lambda n: "a." * (n // 2), "loose mail": lambda n: "x at " * (n // 5),
    "loose hosts": lambda n: "x at y dot " * (n // 11), "addresses in a line": lambda n: "".join(f"http://h{k}.example.com/a;" for k in range(n // 25)), "techniques": lambda n: "".join(f"attack T{1000 + k % 9000}\n" for k in range(n // 13)),
    "techniques after blanks": lambda n: "mitre\n" + "\n" * (n // 2) + "T1059\n" * (n // 12), "brackets": lambda n: "[" * n, "report": lambda n: "".join(f"Host h{k}.example.com (203.0.113.{k % 256}) seen\n" for k in range(n // 45)),
}


def least(f, times=3):
    took = []
    for _ in range(times):
        began = time.thread_time()
        f()
        took.append(time.thread_time() - began)
    return min(took)


@pytest.mark.parametrize("name", INPUTS)
def test_exact_extraction_is_linear(name):
    make, n = INPUTS[name], 20_000
    while least(lambda: exact.extract(make(n)), 1) < 0.05 and n < 320_000:
        n *= 2
    one, two = least(lambda: exact.extract(make(n))), least(lambda: exact.extract(make(2 * n)))
    assert two < 3 * one + 0.05, (n, one, two)
