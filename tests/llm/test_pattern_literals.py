"""Every text in which a pattern is found has all tokens of one of its alternatives."""

import random
import re

import pytest

from inkglass.llm.pattern_literals import alternatives, list_rule

TOKEN = re.compile("[0-9a-z]+")
FIXED = {
    r"(?ia)[?&](sessionid|phpsessid)=": (("phpsessid",), ("sessionid",)), r"(?ia)/cart/(add|remove)([/?#]|$)": (("add", "cart"), ("cart", "remove")), r"(?ia)\.jpe?g$": (("jpeg",), ("jpg",)), r"/Foo\b": (("foo",),), "foo": (), r"(?i)/kiss/": (), r"(?ia)/kiss/": (("kiss",),),
    r"/a[b]c/": (("abc",),), r"/a[bc]/": (), r"/[^a-z0-9A-Z]x[^\w]": (("x",),), r"/x[^a-z]/": (), r"(/x)?/y/": (("y",),), r"(?:/x/|/y/)+z": (("x",), ("y",)), r"/x*/y/": (("y",),), r"(?i:/Q/)": (("q",),), r"/a(?=b)b/": (("ab",),), r"/a|/b/": (), r"é/x/é": (("x",),), r"/(.)x\1/": (), "": (),
}


@pytest.mark.parametrize("pattern", FIXED)
def test_tokens_of_patterns(pattern):
    assert alternatives(pattern) == FIXED[pattern]


def test_tokens_are_in_every_match():
    rng = random.Random(2)

    def made(depth=0):
        kinds = ["a", "b", "K", "/", r"\.", "[ab]", "[/.]", "[^a]", r"\b", r"\w", ".", "^", "$", "é", "x7"]
        if depth < 3:
            kinds += [None] * 5
        k = rng.choice(kinds)
        if k is not None:
            return k
        return rng.choice([lambda: f"(?:{made(depth + 1)}|{made(depth + 1)}{made(depth + 1)})", lambda: f"(?:{made(depth + 1)}{made(depth + 1)}){rng.choice('?*+')}", lambda: f"(?:{made(depth + 1)}{{1,2}})", lambda: f"(?={made(depth + 1)})", lambda: f"({made(depth + 1)}{made(depth + 1)})"])()

    some = found = 0
    for _ in range(4000):
        pattern = rng.choice(["", "(?i)", "(?ia)"]) + "".join(rng.choice(["/", r"\.", ""]) + made() for _ in range(rng.randrange(1, 4))) + rng.choice(["/", r"[/.]", "$", ""])
        try:
            search = re.compile(pattern).search
        except re.error:
            continue
        choices = alternatives(pattern)
        some += bool(choices)
        for _ in range(300 if choices else 0):
            text = "".join(rng.choice(["a", "b", "k", "K", "/", "/", ".", ".", "é", "x7", "A", "\u212a", "_", "\n"]) for _ in range(rng.randrange(1, 7)))
            if search(text):
                found += 1
                own = set(TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
                assert any(own.issuperset(c) for c in choices), (pattern, text, choices)
    assert some > 300 and found > 300, (some, found)


def test_lines_of_filter_lists():
    fits = {"||ex.com^": ["http://ex.com", "https://a.ex.com/x", "http://EX.com:80/"], "|https://ads.": ["https://ads.x"], "/ban/*/img^": ["http://x/ban/1/2/img?"], "@@||a.b^": ["x://a.b/"], ".gif|": ["http://x/y.gif"]}
    other = {"||ex.com^": ["http://badex.com/", "http://x/ex.com", "http://ex.com.org/"], "|https://ads.": ["http://x/https://ads."], "/ban/*/img^": ["http://x/ban/img"], "@@||a.b^": ["x://a.bc/"], ".gif|": ["http://x/y.gif?"]}
    for line, urls in fits.items():
        verdict, pattern = list_rule(line)
        assert verdict == ("allow" if line[0] == "@" else "block")
        assert all(re.search(pattern, u) for u in urls) and not any(re.search(pattern, u) for u in other[line])
        assert alternatives(pattern)
    assert list_rule("! note") is list_rule("") is list_rule("[Adblock]") is None
    for line in ("||x^$third-party", "/regex/", "***"):
        with pytest.raises(ValueError, match="not supported"):
            list_rule(line)
