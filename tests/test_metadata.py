"""Alias chains of any length, circles, and what leads into them, against the reference's walk."""

from mediagrove.operators import metadata


def canonical(aliases: dict[str, str], identity: str) -> str:
    seen, at = set(), identity
    while at not in seen:
        seen.add(at)
        if at not in aliases:
            return at
        at = aliases[at]
    return identity


def test_closure(spark):
    aliases = {f"a{k}": f"a{k + 1}" for k in range(20)}  # a chain of 20 links, and a branch into it
    aliases |= {"b": "a3", "one": "end"}
    aliases |= {f"c{k}": f"c{(k + 1) % 11}" for k in range(11)} | {"x": "y", "y": "x"}  # circles
    aliases |= {"t0": "t1", "t1": "c4"}  # into a circle
    rows = [*aliases.items(), ("doubt", "p"), ("doubt", "q"), ("into", "doubt")]
    got = metadata.closure(metadata.resolve_aliases(spark.createDataFrame(rows, "identity string, canonical string")))
    known = aliases | {"into": "doubt"}
    assert {r.identity: r.canonical for r in got.collect()} == {i: canonical(known, i) for i in known}
    assert canonical(known, "a0") == "a20" and canonical(known, "t0") == "t0"
    none = metadata.closure(metadata.resolve_aliases(spark.createDataFrame([], "identity string, canonical string")))
    assert none.count() == 0


def test_display_titles_of_a_long_chain(spark):
    aliases = spark.createDataFrame([(f"a{k}", f"a{k + 1}") for k in range(20)], "identity string, canonical string")
    titles = spark.createDataFrame([("a20", "The End"), ("a0", "Start")], "identity string, title string")
    got = metadata.display_titles(spark.createDataFrame([("a0",), ("a19",), ("z",)], "identity string"), metadata.resolve_aliases(aliases), titles)
    assert sorted(map(tuple, got.collect())) == [("a0", "a20", "The End"), ("a19", "a20", "The End"), ("z", "z", None)]
