"""The parser of packed fields: notations, malformed quotes, round trips."""

import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histrank.operators.packed import IDS, TITLES, parse_values, split_packed
from tests.conftest import rows


def values(text, notation):
    return [v for _, v, _ in parse_values(text, notation)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("  \t", []), ("[]", []), ("[ ]", []), ("nan", []), ("None", []), ("null", []), ("not_available", []),
        ("['4219', '5']", ["4219", "5"]), ("(1, 2,)", ["1", "2"]), ("[6 7|8]", ["6", "7", "8"]), (" ,6 , , 9;'4'", ["6", "9", "4"]), ("1::2::'3'", ["1", "2", "3"]), ("26", ["26"]), ("3 3 3", ["3"] * 3),
    ],
)
def test_ids(text, want):
    assert values(text, IDS) == want


@pytest.mark.parametrize(
    ("text", "want", "errors"),
    [
        ('["Rasko \\"x\\" 1/4\\"", "b"]', ['Rasko "x" 1/4"', "b"], 0),
        ('A 24 V\n"Tindalo, 3/8"" NPT"\n"1/4"""', ["A 24 V", 'Tindalo, 3/8" NPT', '1/4"'], 0),
        ("'O-Ring Worker''s', 'x'", ["O-Ring Worker's", "x"], 0),
        ("“Safety 3/8\" NPT)”; “Hart; 2 x 50, 24 V”", ['Safety 3/8" NPT)', "Hart; 2 x 50, 24 V"], 0),
        ("O'Mallin Gland :: Kelbrix: 2 x 50", ["O'Mallin Gland", "Kelbrix: 2 x 50"], 0),
        ('"unclosed, b', ["unclosed", "b"], 1),
        ("[a, b", ["a", "b"], 2),
        ('"a"\t"b"', ["a", "b"], 0),
    ],
)
def test_titles(text, want, errors):
    got = parse_values(text, TITLES)
    assert [v for _, v, _ in got] == want
    assert [p for p, _, _ in got] == list(range(len(want)))
    assert sum(e for *_, e in got) == errors


@pytest.mark.parametrize(
    ("text", "want", "errors"),
    [
        ("[a],[b]", ["[a]", "[b]"], 0), ("(1), (2)", ["(1)", "(2)"], 0), ("[a, [b; c], d]", ["a", "[b; c]", "d"], 0), ("‘a, b’", ["a, b"], 0), ("«a; b»", ["a; b"], 0),
        ("[New] Widget; B", ["[New] Widget", "B"], 0), ("(a, b", ["(a", "b"], 1), ('[{"a, ]": 1}, b]', ['{"a, ]": 1}', "b"], 0), ("x, (y; (z)), w", ["x", "(y; (z))", "w"], 0), ("[,[,", ["["], 1),
    ],
)
def test_brackets(text, want, errors):
    got = parse_values(text, TITLES)
    assert [v for _, v, _ in got] == want and sum(e for *_, e in got) == errors


WORDS = st.lists(st.text(st.sampled_from("ab,;|\"'\\x: ”é"), min_size=1, max_size=8).map(str.strip).filter(lambda x: x and x not in "\"'"), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_json_round_trip(words):
    assert values(json.dumps(words, ensure_ascii=False), TITLES) == words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from('ab,;|"x: é'), min_size=1, max_size=8).map(str.strip).filter(lambda x: x and x != '"'), min_size=1, max_size=6))
def test_csv_round_trip(words):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(words)
    assert values(out.getvalue(), TITLES) == words


def test_long_texts_are_linear():
    assert len(values("[," * 200_000, TITLES)) == 199_999
    assert len(values("(a," * 100_000, IDS)) == 100_000
    assert len(values('""' * 200_000 + "x", TITLES)) == 1
    assert len(values(",".join(map(str, range(200_000))), IDS)) == 200_000


def test_split_packed(spark):
    df = spark.createDataFrame([(1, "a,b", 0), (1, "a,b", 0), (None, "c", 1), (2, None, 1)], "id int, text string, value_pos int")
    assert rows(split_packed(df, "id", "text", TITLES)) == sorted([(1, 0, "a", False), (1, 1, "b", False)] * 2 + [(None, 0, "c", False)], key=repr)
    assert rows(split_packed(df.where("false"), "id", "text", TITLES)) == []
