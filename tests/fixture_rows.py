"""The 200-row golden column and its 28 golden truths."""

import json
from pathlib import Path


def golden_rows() -> list[bytes]:
    """Fixed values, as they stand in golden_rows.json: the golden checksum and truths depend on them."""
    return [r.encode() for r in json.loads(Path(__file__).with_name("golden_rows.json").read_text())]


# The checksum of the rows; operator, needles, matches and bitmap hash.
CHECKSUM = "xxh3:fd10cb1408b8396f"
GOLDEN = [
    ("prefix", ["https://"], 139, "ffc6a329b79dd67a"), ("prefix", ["http"], 186, "9eb2310799796681"), ("prefix", ["https://google.com/"], 20, "ba93ba232de5769d"),
    ("prefix", [""], 200, "a9f9bb85deeaf1ad"), ("prefix", ["ftp://"], 0, "a057271c9071c99d"), ("suffix", [".html"], 9, "c67158f9f4ae4fc5"),
    ("suffix", ["/"], 7, "7fee950b64f47a3f"), ("suffix", [""], 200, "a9f9bb85deeaf1ad"), ("suffix", ["google"], 2, "e25db44d546c6975"),
    ("suffix", [".exe"], 0, "a057271c9071c99d"), ("contains", ["google"], 29, "acad5c4f2e00711b"), ("contains", ["a"], 183, "0838b4c733db30e4"),
    ("contains", [""], 200, "a9f9bb85deeaf1ad"), ("contains", ["zzz-not-present"], 0, "a057271c9071c99d"), ("contains", ["aa"], 2, "c56d01cae02f271b"),
    ("contains", ['comma,and"'], 1, "e603326a5dc0ebce"), ("contains", ["\x7f\x01"], 1, "8a2ae8e6aee2010d"), ("contains", ["x" * 32], 1, "1a2806ca257cd486"),
    ("multi_contains", ["http", "google", "html"], 8, "19db1492024ccf5e"), ("multi_contains", ["html", "http"], 0, "a057271c9071c99d"),
    ("multi_contains", ["ab", "ab"], 27, "b3008ae74aafe1c3"), ("multi_contains", ["aa", "aa"], 1, "7adf3d61b0689611"),
    ("multi_contains", ["http", "", "com"], 64, "ff25a1ea84eaddd7"), ("multi_contains", ["search"], 34, "1c470ff8546a2ab2"),
    ("contains_any", ["google", "yandex"], 66, "b37b7ad9f91d1372"), ("contains_any", ["zzz-not-present", "https"], 139, "ffc6a329b79dd67a"),
    ("contains_any", ["google", "google"], 29, "acad5c4f2e00711b"), ("contains_any", ["qqq-absent", "www-absent"], 0, "a057271c9071c99d"),
]
