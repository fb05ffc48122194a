"""P6 operator: round trips through every notation, and hostile cells."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.operators.packed import tokenize, unpack

VALUES = st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00", exclude_categories=["Cc", "Zs", "Zl", "Zp", "Cs"]) | st.sampled_from(' ,;|:"\\\''), min_size=1, max_size=12).map(str.strip).filter(bool), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([",", ";", "|", " ", "\n", "\t", ", ", " | ", "\r\n\t"]))
def test_round_trip(values, separator):
    assert tokenize(json.dumps(values)) == values
    assert tokenize(json.dumps(values, ensure_ascii=False, separators=(",", ":"))) == values
    assert tokenize(repr(values)) == values
    assert tokenize(json.dumps({v: {"x": [1]} for v in values})) == list(dict.fromkeys(values))
    escaped = ["".join("\\" + c if c in " ,;|:\"'\\" or c.isspace() else c for c in v) for v in values]
    doubled = ['"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values]
    slashed = ['"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values]
    for written in (doubled, slashed, escaped):
        if not written[0].startswith(("[", "{")):
            assert tokenize(separator.join(written), True) == values


def test_cells():
    assert tokenize(None) == tokenize("") == tokenize(" \n") == tokenize("[]") == tokenize("{}") == tokenize(" ; ,|") == []
    assert tokenize("a,,b;;c|") == ["a", "b", "c"] and tokenize("a a") == ["a", "a"]
    assert tokenize('["-p", 48054, null, "", " x ", true, 1.5]') == ["-p", "48054", "x", "true", "1.5"]
    assert tokenize("['a', 'it\\'s', \"b\"]") == ["a", "it's", "b"]
    assert tokenize('["gr\\u00f6\\u00dfe", "\\ud83d\\ude00"]') == ["größe", "😀"]
    assert tokenize("/a:/b", True) == ["/a", "/b"] and tokenize("/a:/b") == ["/a:/b"]
    assert tokenize("'a|b x\\x' y") == ["a|b x\\x", "y"]
    assert tokenize('"the ""x"" agent" --t=the\\ \\"y\\"') == ['the "x" agent', '--t=the "y"']
    assert tokenize("[1, 2") and tokenize('"open') == ["open"] and tokenize("a\\") == ["a\\"]
    assert tokenize('[["a"], "b"]') == ['["a"]', "b"]


def test_long_and_many(spark):
    big = ";".join(["v" * 100] * 20_000)
    df = spark.createDataFrame([(1, big, None, 7), (1, "x y", "[1]", 8), (2, None, None, 9)], "id long, a string, b string, pos int")
    rows = unpack(df, "t", ("a", "b"))
    assert rows.where("field = 'a'").count() == 20_002 and rows.where("field = 'b'").count() == 1
    assert unpack(df.limit(0), "t", ("a",)).count() == 0
    assert rows.columns == ["entity_table", "row_id", "field", "pos", "value"]
