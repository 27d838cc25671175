"""Query words, times and cursors: boundaries by hand."""

import pytest

from tessera.functions import queries as Q

NOW = Q.utc(2024, 3, 13, 15, 30)  # a Wednesday


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-02T03:04:05Z", Q.utc(2024, 1, 2, 3, 4, 5)),
        ("1h30m", Q.utc(2024, 3, 13, 14)),
        ("90m", Q.utc(2024, 3, 13, 14)),
        ("2d", Q.utc(2024, 3, 11, 15, 30)),
        ("1W", Q.utc(2024, 3, 6, 15, 30)),
        ("1mo", Q.utc(2024, 2, 12, 15, 30)),
        ("1y", Q.utc(2023, 3, 14, 15, 30)),
        (" 0.5d ", Q.utc(2024, 3, 13, 3, 30)),
    ],
)
def test_times(text, want):
    assert Q.parse_time(text, NOW) == want


@pytest.mark.parametrize("text", ["", "  ", "0s", "-1d", "-1h", "soon", "5", "1 d", "2024-01-02"])
def test_no_times(text):
    with pytest.raises(ValueError):
        Q.parse_time(text, NOW)


@pytest.mark.parametrize(
    "query, want",
    [
        ("changes in the last 7 days", (Q.utc(2024, 3, 6, 15, 30), None)),
        ("past 2 weeks", (Q.utc(2024, 2, 28, 15, 30), None)),
        ("last 3 months", (Q.utc(2023, 12, 13, 15, 30), None)),
        ("This week", (Q.utc(2024, 3, 11), None)),
        ("today", (Q.utc(2024, 3, 13), None)),
        ("yesterday's notes", (Q.utc(2024, 3, 12), Q.utc(2024, 3, 13))),
        ("recently", (Q.utc(2024, 3, 6, 15, 30), None)),
        ("plain words", None),
    ],
)
def test_temporal_intent(query, want):
    assert Q.temporal_intent(query, NOW) == want


def test_words():
    assert Q.relaxed_terms("Show the user's LOGIN, flow!") == ["users", "login", "flow"]
    assert Q.keywords("How does the Auth-flow (login) work? a x login") == ["auth-flow", "login", "work"]
    assert Q.query_entities("(UserService) the getX, getX") == ["userservice", "getx"]
    q = Q.web_query('"exact phrase" cat or dog -"not this" Bird')
    assert q.groups == ((("exact", "phrase"),), (("cat",), ("dog",)), (("bird",),)) and q.excluded == (("not", "this"),)
    assert Q.web_query("or").groups == () and Q.web_query("a or b or c").groups == ((("a",), ("b",), ("c",)),)


def test_cursor():
    key = Q.filter_key("q", ["b", "a"], "ws", [], ["", ""])
    assert key == Q.filter_key("q", ["a", "b"], "ws", [], ["", ""]) and len(key) == 16
    assert Q.decode_cursor(Q.encode_cursor(40, key), key) == 40
    for bad in (Q.encode_cursor(40, "other"), Q.encode_cursor(10_001, key), Q.encode_cursor(-1, key), "%%%", ""):
        with pytest.raises(ValueError):
            Q.decode_cursor(bad, key)
