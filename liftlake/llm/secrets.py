"""Secret scan by corpus-wide ownership frequency (dealt operator 2).

Built from DataFrame and SQL functions alone.  The base patterns give spans;
a broader pattern gives candidates, strings that look like machine-made keys.
All candidate values are hashed and counted over the whole corpus by distinct
repositories and owners: a value that many owners have is a copied example,
and so is one that very many repositories of a single owner have; others look
live.  Live-looking candidates outside the
base spans become spans of the kind ``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from liftlake.llm.runtime import written

#: Fixed patterns of the contract, in the order of its kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
#: Candidates: 20 or more key characters with a digit and a letter.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A value held by this many owners or more is a copied example.
EXAMPLE_OWNERS = 2
#: So is one that this many repositories of its owners hold.
EXAMPLE_REPOSITORIES = 100

_SPAN = "struct<kind:string,place:int,start:int,end:int,value:string>"
#: Items of an array that one inner walk takes: walks copy what they have
#: gathered at every item, so a long array is walked in parts.
_PART = 256


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not in every inner step."""
    return F.transform(F.array(value), body)[0]


def _walk(items: Column, state: Column, fold, emit, kind: str) -> Column:
    """``emit(state, item)`` of every item, the state folded along the array.

    The states at which parts begin are found first, then each part is walked
    by itself: time grows with the length, not with its square.
    """
    def parts(whole: Column) -> Column:
        return F.transform(F.when(F.size(whole) > 0, F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / _PART).cast("int")))
                           .otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.slice(whole, i * _PART + 1, F.lit(_PART)))

    def starts(cut: Column) -> Column:
        first = F.struct(state.alias("state"), F.slice(F.array(state), 1, F.lit(0)).alias("seen"))
        return F.aggregate(cut, first, lambda acc, part: F.struct(
            F.aggregate(part, acc["state"], fold).alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen")))["seen"]

    def inside(part: Column, begun: Column) -> Column:
        first = F.struct(begun.alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(
            fold(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x).cast(kind))).alias("out")))["out"]

    return _bound(items, lambda whole: _bound(parts(whole), lambda cut: F.flatten(F.zip_with(cut, starts(cut), inside))))


def _spans(text: Column, pattern: str, kind: str, place: int, value_group: int, keep) -> Column:
    """Spans of all matches of a pattern that cannot match the empty string:
    the gaps between matches and the matches' lengths give the positions."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(value_group)) if value_group > 1 else whole
    gaps = F.split(text, pattern, -1)
    steps = _bound(whole, lambda found: F.zip_with(
        F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("w"), value.alias("v")),
        lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["w"]).alias("size"), m["v"].alias("value"))))
    walked = _walk(steps, F.lit(0), lambda at, s: at + s["gap"] + s["size"], lambda at, s: F.when(keep(s), F.struct(
        F.lit(kind).alias("kind"), F.lit(place).alias("place"), (at + s["gap"]).alias("start"),
        (at + s["gap"] + s["size"]).alias("end"), s["value"].alias("value"))), _SPAN)
    # only texts that can have a span are taken apart
    return F.when(text.rlike(pattern), F.filter(walked, lambda s: s.isNotNull())).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _clear(cand: Column, base: Column) -> Column:
    """The candidates that meet no base span: those that begin at or behind the
    furthest end of the base spans begun before, and end before the next."""
    none = F.lit(2 ** 31 - 1)
    span = "struct<start:int,base:boolean,end:int,value:string,clear:boolean>"

    def item(is_base: bool):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(not is_base).alias("later"), s["end"].alias("end"),
                                  s["value"].alias("value"))
    line = F.array_sort(F.concat(F.transform(base, item(True)), F.transform(cand, item(False))))
    before = _walk(line, F.lit(0), lambda far, s: F.when(s["later"], far).otherwise(F.greatest(far, s["end"])),
                   lambda far, s: F.struct(s["start"], ~s["later"], s["end"], s["value"], far <= s["start"]), span)
    after = _walk(F.reverse(before), none, lambda near, s: F.when(s["base"], s["start"]).otherwise(near),
                  lambda near, s: F.struct(s["start"], s["base"], s["end"], s["value"], s["clear"] & (s["end"] <= near)), span)
    kept = F.transform(F.filter(after, lambda s: ~s["base"] & s["clear"]), lambda s: F.struct(
        F.lit("live").alias("kind"), F.lit(3).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(F.size(cand) > 0, F.when(F.size(base) > 0, F.reverse(kept)).otherwise(cand)).otherwise(cand)


def _judged(cand: Column, held: Column) -> Column:
    """Candidates (start, end, value) with repositories, owners and example of
    their values, by start: both sides ordered by hash, then walked once."""
    facts = "struct<repositories:bigint,owners:bigint,example:boolean>"
    blank = F.expr(f"cast(null as {facts})")
    entry = F.transform(held, lambda h: F.struct(h["hash"].alias("hash"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
                                                 F.lit("").alias("value"), h["facts"].cast(facts).alias("facts")))
    asked = F.transform(cand, lambda c: F.struct(F.unhex(F.sha2(c["value"].cast("binary"), 256)).alias("hash"), c["start"].alias("start"),
                                                 c["end"].alias("end"), c["value"].alias("value"), blank.alias("facts")))
    line = F.array_sort(F.concat(entry, asked))
    walked = _walk(line, blank, lambda now, s: F.when(s["start"] < 0, s["facts"]).otherwise(now),
                   lambda now, s: F.struct(s["start"], s["end"], s["value"], now["repositories"], now["owners"], now["example"]),
                   "struct<start:int,end:int,value:string,repositories:bigint,owners:bigint,example:boolean>")
    return F.array_sort(F.filter(walked, lambda s: s["start"] >= 0))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _by_place(spans: Column) -> Column:
    key = F.transform(spans, lambda s: F.struct(s["start"], s["place"].alias("place"), s["kind"].alias("kind"), s["end"], s["value"].alias("value")))
    return F.array_sort(key)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, repository, owner, assign, access, hex and cand (arrays of spans)."""
    text = F.col("body")
    found = docs.select(
        "doc_id", "repository", "owner", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    return found.select(
        "doc_id", "repository", "owner",
        _spans(text, ASSIGN, "assign", 0, 3, lambda s: F.length(s["value"]) >= 6).alias("assign"),
        _spans(text, ACCESS, "access", 1, 1, lambda s: s["size"] >= 20).alias("access"),
        # runs of 24 and more are found whole, shorter ones are no match
        _spans(text, r"[0-9a-f]{24,}", "hex", 2, 1, lambda s: F.lit(True)).alias("hex"),
        _spans(text, CANDIDATE, "live", 3, 1,
               lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("cand"))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories, owners: over how many distinct repositories and
    owners each candidate hash (columns hash, repository, owner) is spread.

    Every step combines before its shuffle, so a value that a large share of
    all rows holds costs a row for each task, repository and owner.
    """
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("seen"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("seen").alias("seen"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"),
                                        F.count(F.lit(1)).alias("owners"), F.sum("seen").alias("seen"))


def secret_scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source",
                example_owners: int = EXAMPLE_OWNERS,
                example_repositories: int | None = EXAMPLE_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_live, n_example (distinct values that are copied examples) and
    spread, the counts of every candidate outside the base spans: start, end,
    repositories, owners.

    A value is an example from ``example_owners`` owners or from
    ``example_repositories`` repositories on; with None owners alone decide.

    Positions are code points, ends exclusive.  Null texts count as empty and
    have no span.  A null owner is an owner of its own, as is a null
    repository.  Repeated rows get the same spans, each on its own row; empty
    tables give an empty result; only the named columns are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    found = base_spans(docs)
    base = _by_place(F.concat("assign", "access", "hex"))
    clear = _clear(F.col("cand"), F.concat("assign", "access", "hex"))
    found = found.select("doc_id", "repository", "owner", base.alias("base"), clear.alias("cand"),
                         F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
                         F.size("hex").cast("long").alias("n_hex"))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    values = found.select("row", "repository", "owner", F.explode(F.array_distinct(F.concat(
        F.transform("base", lambda s: s["value"]), F.transform("cand", lambda s: s["value"])))).alias("value")).select(
        "row", "repository", "owner", F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("hash"))
    spread = ownership(values)
    example = F.col("owners") >= example_owners
    if example_repositories is not None:
        example = example | (F.col("repositories") >= example_repositories)
    judged = values.join(spread, "hash").groupBy("row").agg(
        F.collect_list(F.struct("hash", F.struct("repositories", "owners", example.alias("example")).alias("facts"))).alias("held"),
        F.count(F.when(example, 1)).alias("n_example"))
    cand = F.when(F.size("cand") > 0, _judged(F.col("cand"), F.col("held"))).otherwise(
        F.expr("cast(array() as array<struct<start:int,end:int,value:string,repositories:bigint,owners:bigint,example:boolean>>)"))
    found = found.join(judged, "row", "left").withColumn("cand", cand)
    own = F.transform(F.filter("cand", lambda c: ~c["example"]), lambda c: F.struct(
        c["start"].alias("start"), F.lit(3).alias("place"), F.lit("live").alias("kind"), c["end"].alias("end"), c["value"].alias("value")))
    spans = F.array_sort(F.concat("base", own))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"),
        F.size(own).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.transform("cand", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["repositories"].alias("repositories"),
                                               c["owners"].alias("owners"))).alias("spread"))
