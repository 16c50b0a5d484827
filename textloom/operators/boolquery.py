"""Boolean search: a query text becomes a tree, the tree a DataFrame plan over the index or an expression over documents.

Operators by rising precedence: | & ! and parentheses; terms are words. Negation is pushed to the leaves. compat=True gives the two
habits of older indexes: the last document is in no complement, and an outer sign replaces the sign of what it stands before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.index import Stored


@dataclass(frozen=True)
class Term:
    word: str
    negated: bool = False


@dataclass(frozen=True)
class Op:
    kind: str  # & or |
    parts: tuple


Node = Term | Op
LEX = re.compile(r"\s*([()&|!]|[^\s()&|!]+)")


def lexemes(query: str) -> list[str]:
    out, at = [], 0
    query = query.strip()
    while at < len(query):
        m = LEX.match(query, at)
        out.append(m[1].lower())
        at = m.end()
    return out


def parse(query: str, compat: bool = False) -> Node:
    """The query's tree with negation at the leaves. ValueError for a query that isn't well formed, adjacent terms included."""
    toks = lexemes(query)
    at = 0

    def peek() -> str:
        return toks[at] if at < len(toks) else ""

    def take(kind: str) -> Node:
        nonlocal at
        sub = unary if kind == "&" else lambda: take("&")
        parts = [sub()]
        while peek() == kind:
            at += 1
            parts.append(sub())
        return parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def unary() -> Node:
        nonlocal at
        t = peek()
        at += 1
        if t == "!":
            if peek() == "(" and compat:
                return signed(unary(), True)
            return negate(unary())
        if t == "(":
            node = take("|")
            if peek() != ")":
                raise ValueError(f"missing ) in {query!r}")
            at += 1
            return node
        if not t or t in "()&|":
            raise ValueError(f"a term is missing in {query!r}")
        return Term(t)

    tree = take("|")
    if at < len(toks):
        raise ValueError(f"unexpected {toks[at]!r} in {query!r}")
    return tree


def negate(n: Node) -> Node:
    if isinstance(n, Term):
        return Term(n.word, not n.negated)
    return Op("|" if n.kind == "&" else "&", tuple(negate(p) for p in n.parts))


def signed(n: Node, sign: bool) -> Node:
    """compat: a sign before parentheses replaces a lone term's own sign."""
    return Term(n.word, sign) if isinstance(n, Term) else negate(n) if sign else n


def terms(n: Node) -> set[str]:
    return {n.word} if isinstance(n, Term) else set().union(*map(terms, n.parts))


def flat(n: Node) -> Node:
    """Nested operators of one kind joined."""
    if isinstance(n, Term):
        return n
    parts: list[Node] = []
    for p in map(flat, n.parts):
        parts += p.parts if isinstance(p, Op) and p.kind == n.kind else [p]
    return Op(n.kind, tuple(dict.fromkeys(parts)))


def search(index: Stored, query: str, compat: bool = False) -> DataFrame:
    """doc_id of the documents that match, as set algebra over the posting lists of a stored index.

    A leaf reads its term's row groups. In a conjunction the rarest term leads, further terms are
    semi-joins and negated ones anti-joins, so the universe is read only for a conjunction without a positive part.
    An unknown term matches nothing."""
    tree, universe = flat(parse(query, compat)), index.universe
    if compat:
        last = universe.agg(F.max("doc_id").alias("last"))
        universe = universe.join(last, F.col("doc_id") < F.col("last")).select("doc_id")
    df = index.df(*terms(tree))

    def leaf(word: str) -> DataFrame:
        return index.docs(word).select("doc_id")

    def weight(n: Node) -> int:
        if isinstance(n, Term):
            return df.get(n.word, 0)
        w = [weight(p) for p in n.parts]
        return min(w) if n.kind == "&" else sum(w)

    def plan(n: Node) -> DataFrame:
        if isinstance(n, Term):
            return universe.select("doc_id").join(leaf(n.word), "doc_id", "left_anti") if n.negated else leaf(n.word)
        if n.kind == "|":
            out = None
            for p in map(plan, n.parts):
                out = p if out is None else out.unionAll(p)
            return out.distinct()
        minus = [p for p in n.parts if isinstance(p, Term) and p.negated]
        plus = sorted((p for p in n.parts if p not in minus), key=weight)
        out = plan(plus[0]) if plus else universe.select("doc_id")
        for p in plus[1:]:
            out = out.join(plan(p), "doc_id", "left_semi")
        for p in minus:
            out = out.join(leaf(p.word), "doc_id", "left_anti")
        return out

    return plan(tree).distinct()


def matches(w: Column, n: Node) -> Column:
    """Whether a document with the words w matches."""
    if isinstance(n, Term):
        has = F.array_contains(w, n.word)
        return ~has if n.negated else has
    out = None
    for p in n.parts:
        m = matches(w, p)
        out = m if out is None else (out & m if n.kind == "&" else out | m)
    return out


def holds(n: Node, have: frozenset[str] = frozenset()) -> bool:
    """Whether a document with the words `have` matches."""
    if isinstance(n, Term):
        return (n.word in have) != n.negated
    return (all if n.kind == "&" else any)(holds(p, have) for p in n.parts)


def search_many(index: Stored, queries: list[str], at_once: int = 64) -> DataFrame:
    """query, doc_id for many queries: one read of the named terms' posting lists, one shuffle that gives each document its named terms, on
    which all trees are evaluated. The universe is read only for queries that a document without any named term matches. Queries are taken
    at_once at a time, as each is an expression of the plan."""
    out = None
    asked = list(dict.fromkeys(queries))
    for k in range(0, len(asked), at_once):
        part = asked[k : k + at_once]
        trees = [parse(q) for q in part]
        rows = index.docs(*sorted(set().union(*map(terms, trees)))).groupBy("doc_id").agg(F.collect_set("term").alias("w"))
        if any(map(holds, trees)):
            rows = index.universe.join(rows, "doc_id", "left").select("doc_id", F.coalesce("w", F.array().cast("array<string>")).alias("w"))
        hits = F.filter(F.array(*[F.when(matches(F.col("w"), t), F.lit(q)) for q, t in zip(part, trees, strict=True)]), lambda q: q.isNotNull())
        found = rows.select("doc_id", F.explode(hits).alias("query"))
        out = found if out is None else out.unionAll(found)
    return out if out is not None else index.universe.select("doc_id", F.lit("").alias("query")).limit(0)


def scan_many(docs: DataFrame, queries: list[str]) -> DataFrame:
    """The same without an index, in one scan of the documents: each document's words are kept to those the queries name and all trees
    are evaluated on them. No shuffle, no join."""
    trees = [parse(q) for q in queries]
    named = sorted(set().union(*map(terms, trees))) if trees else []
    words = F.coalesce(T.words(F.col("text")), F.array().cast("array<string>"))
    rows = docs.where("doc_id is not null").select("doc_id", F.array_intersect(words, F.lit(named)).alias("w"))
    hits = F.filter(F.array(*[F.when(matches(F.col("w"), t), F.lit(q)) for q, t in zip(queries, trees, strict=True)]), lambda q: q.isNotNull())
    return rows.select("doc_id", F.explode(hits).alias("query")).distinct()


def report(hits: DataFrame, queries: list[str]) -> DataFrame:
    """query and n, its number of documents; queries without a match have 0."""
    asked = hits.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    return asked.join(hits.groupBy("query").agg(F.count("*").alias("n")), "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"))
