"""The keyword query language: words, "phrases", pre*, AND / OR / NOT, a NEAR/n b, parentheses.

A query is parsed on the driver into a tree over phrases. Implicit AND binds tightest, then NOT, AND, OR.
Runs of two or more CJK characters outside quotes become a NEAR of their characters. A query that does not
parse is reduced to letters, numbers and spaces and parsed once more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_CJK = "一-鿿㐀-䶿豈-﫿぀-ヿ가-힯ᄀ-ᇿ々"
_CJK_RUN = re.compile(f"[{_CJK}]{{2,}}")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
_TOKEN = re.compile(r'"[^"]*"?|[()]|[^\s()"]+')


class QuerySyntaxError(ValueError):
    """A form that is refused outright, or a query that cannot be read even when reduced."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


@dataclass
class Query:
    tree: object
    phrases: list[Phrase] = field(default_factory=list)


def is_cjk(c: str) -> bool:
    return bool(re.match(f"[{_CJK}]", c))


def words_of(text: str) -> tuple[str, ...]:
    """The indexer's tokens of a query text: CJK characters apart, lower case."""
    spaced = re.sub(f"([{_CJK}])", r" \1 ", text)
    return tuple(w.lower() for w in _WORD.findall(spaced))


def refuse(query: str) -> None:
    bare = re.sub(r'"[^"]*"', '"', query)
    if re.search(r"(?i)\bNEAR\s*\(", bare):
        raise QuerySyntaxError('NEAR(...) is not supported; write a NEAR/50 b')
    if re.search(r'(?i)[^\s(),]+\s+NEAR\s+[^\s(),]+', bare):
        raise QuerySyntaxError("NEAR needs a distance; write a NEAR/50 b")


class _Parser:
    def __init__(self, query: str):
        self.tokens, self.at = self._expand(_TOKEN.findall(query)), 0

    @staticmethod
    def _expand(tokens: list[str]) -> list[str]:
        """CJK runs stand apart from what they touch."""
        out: list[str] = []
        for t in tokens:
            if t[0] == '"' or not _CJK_RUN.search(t):
                out.append(t)
            else:
                out += [x for x in re.split(f"([{_CJK}]{{2,}})", t) if x]
        return out

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def any_(self):
        left = self.all_()
        while self.peek() == "OR":
            self.next()
            left = Op("or", left, self.all_())
        return left

    def all_(self):
        left = self.but()
        while self.peek() == "AND":
            self.next()
            left = Op("and", left, self.but())
        return left

    def but(self):
        left = self.together()
        while self.peek() == "NOT":
            self.next()
            left = Op("not", left, self.together())
        return left

    def together(self):
        left = self.near()
        while self.peek() not in (None, "OR", "AND", "NOT", ")"):
            if self.peek() == "(":
                raise QuerySyntaxError("an operator is missing before a parenthesis")
            left = Op("and", left, self.near())
        return left

    def near(self):
        left = self.unit()
        while re.fullmatch(r"(?i)NEAR/\d+", self.peek() or ""):
            n, right = int(self.next().split("/")[1]), self.unit(quoted_cjk=True)
            if not all(isinstance(x, Phrase) or isinstance(x, Near) for x in (left, right)):
                raise QuerySyntaxError("NEAR takes words or phrases")
            flat = [p for x in (left, right) for p in ((x,) if isinstance(x, Phrase) else (Phrase(tuple(w for q in x.phrases for w in q.words)),))]
            left = Near(tuple(flat), n)
        return left

    def unit(self, quoted_cjk: bool = False):
        token = self.peek()
        if token is None or token in ("OR", "AND", "NOT", ")"):
            raise QuerySyntaxError(f"a term is missing before {token}")
        self.next()
        if token == "(":
            inner = self.any_()
            if self.peek() != ")":
                raise QuerySyntaxError("a parenthesis is open")
            self.next()
            if self.peek() not in (None, "OR", "AND", "NOT", ")"):
                raise QuerySyntaxError("an operator is missing after a parenthesis")
            return inner
        if token[0] == '"':
            return Phrase(words_of(token.strip('"')))
        if _CJK_RUN.fullmatch(token):
            near_next = re.fullmatch(r"(?i)NEAR/\d+", self.peek() or "")
            return Phrase(tuple(token)) if quoted_cjk or near_next else Near(tuple(Phrase((c,)) for c in token), max(1, len(token) - 1))
        star = token.endswith("*")
        body = token[:-1] if star else token
        if not body or re.search(r"[^\w]", body, re.UNICODE):
            raise QuerySyntaxError(f"cannot read {token}")
        return Phrase(words_of(body), star)


def parse_strict(query: str) -> Query:
    parser = _Parser(query)
    tree = parser.any_()
    if parser.peek() is not None:
        raise QuerySyntaxError(f"cannot read {parser.peek()}")
    found: list[Phrase] = []

    def walk(x) -> None:
        for p in [x] if isinstance(x, Phrase) else x.phrases if isinstance(x, Near) else ():
            found.append(p)
        if isinstance(x, Op):
            walk(x.left)
            walk(x.right)

    walk(tree)
    return Query(tree, list(dict.fromkeys(found)))


def parse(query: str) -> Query:
    """Parses a query, falling back once to its bare words."""
    if not query or not query.strip():
        raise QuerySyntaxError("a query cannot be empty")
    refuse(query)
    try:
        return parse_strict(query)
    except QuerySyntaxError:
        bare = re.sub(r"[^\w\s]|_", " ", query).strip()
        if not bare:
            raise
        refuse(bare)
        return parse_strict(bare)


def single_phrase(query: str) -> str | None:
    """The inside of a query that is one quoted phrase of two or more words or CJK characters, and nothing else."""
    found = re.fullmatch(r'\s*"([^"]*)"\s*', query)
    if not found or len(words_of(found[1])) < 2:
        return None
    return found[1]


def anchors(query: str) -> list[tuple[str, bool]]:
    """Texts to look for around a hit, best first: phrases, the whole literal, then words; longer before shorter."""
    phrases = re.findall(r'(?<!\bNOT\s)"([^"]*)"', query)
    bare = re.sub(r'"[^"]*"', " ", query)
    out: list[tuple[int, str, bool]] = [(0, " ".join(p.split()), False) for p in phrases]
    if not phrases and not re.search(r"(?i)\b(?:AND|OR|NOT|NEAR(?:/\d+)?)\b", bare):
        literal = " ".join(re.sub(r"[^\w*]|_", " ", query).split())
        if " " in literal or re.search(f"[{_CJK}]", literal):
            out.append((1, literal, False))
    bare = re.sub(r"(?i)\bNOT\s+\w+\*?", " ", bare)
    bare = re.sub(r"(?i)\bNEAR/\d+\b", " ", bare)
    for word in re.findall(r"[^\W_]+\*?", bare):
        text = word.rstrip("*")
        if text and not text.isdigit() and text.upper() not in ("AND", "OR", "NOT", "NEAR"):
            out.append((2, text, word.endswith("*")))
    ordered = sorted(((p, t, x) for p, t, x in out if t), key=lambda c: (c[0], -len(c[1])))
    return [(t, x) for t, x in dict.fromkeys((t.lower(), x) for _, t, x in ordered)]
