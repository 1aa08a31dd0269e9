"""Best representative of each duplicate group (problem 1)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions.ids import standard_tube
from tallygrove.llm.graph import seed_tree_components
from tallygrove.session import Stash

#: Barcodes under one accession up to this many are compared in place; beyond it by shared neighbours. Both are exact.
PLACE_LIMIT = 24


@dataclass(frozen=True)
class Bundle:
    """Fields that depend on each other and are taken from one record as a whole. `usable` says which records may give it."""

    name: str
    fields: Sequence[str]
    usable: Column | None = None


@dataclass(frozen=True)
class Dependency:
    """The survivor's `determinant` must go with the `dependent` value that the most trusted records give it.

    A binding dependency comes before trust; any other one only decides between choices of equal trust and recency.
    """

    determinant: str
    dependent: str
    binding: bool = True


def one_error_links(df: DataFrame, scope: str, code: str, place_limit: int = PLACE_LIMIT) -> DataFrame:
    """(a, b): pairs of different codes under one scope that can be mistyped forms of one code.

    One error is a changed character or two neighbours swapped; two codes are linked if some code of the same length is
    at most one error from each. Scopes with few codes compare them in place. Larger ones, of any size, are linked
    without comparing all pairs: each code meets its one-error neighbours (digits), and ties itself to the smallest code
    that meets the same neighbour. Null scopes or codes link nothing.
    """
    codes = df.select(F.col(f"`{scope}`").alias("s"), F.col(f"`{code}`").alias("c")).where(F.col("s").isNotNull() & F.col("c").isNotNull()).distinct()
    sized = codes.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    several = codes.join(sized, "s")
    few = several.where(F.col("n") <= place_limit).groupBy("s").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    # the 24 codes at most of such a scope are paired in its own row
    left = few.select("cs", F.posexplode("cs").alias("i", "a"))
    close = left.select("a", F.explode(F.expr("filter(slice(cs, i + 2, size(cs)), b -> levenshtein(a, b, 4) >= 0 and length(a) = length(b))")).alias("b"))
    differs = F.expr("filter(sequence(1, length(a)), k -> substr(a, k, 1) <> substr(b, k, 1))")
    shape = close.withColumn("d", differs)
    swap = lambda x, k: f"concat(substr({x}, 1, {k} - 1), substr({x}, {k} + 1, 1), substr({x}, {k}, 1), substr({x}, {k} + 2))"
    # within one swap and then one change or swap of each other, tried at every place
    by_swap = F.expr(f"exists(sequence(1, length(a) - 1), k -> size(filter(sequence(1, length(a)), j -> substr({swap('a', 'k')}, j, 1) <> substr(b, j, 1))) <= 1 or exists(sequence(1, length(b) - 1), l -> {swap('a', 'k')} = {swap('b', 'l')}))")
    in_place = shape.where((F.size("d") <= 2) | ((F.size("d") <= 4) & (F.length("a") > 1) & by_swap)).select("a", "b")
    # any number of codes: neighbours as join keys
    many = several.where(F.col("n") > place_limit)
    keys = many.select(
        "s",
        "c",
        F.explode(
            F.expr(
                "array_distinct(concat(array(c), "
                "flatten(transform(sequence(1, length(c)), k -> transform(sequence(0, 9), v -> concat(substr(c, 1, k - 1), cast(v as string), substr(c, k + 1))))), "
                "transform(sequence(1, greatest(length(c) - 1, 1)), k -> concat(substr(c, 1, k - 1), substr(c, k + 1, 1), substr(c, k, 1), substr(c, k + 2)))))"
            )
        ).alias("k"),
    )
    lowest = keys.groupBy("s", "k").agg(F.min("c").alias("b"), F.max("c").alias("top")).where(F.col("b") != F.col("top")).drop("top")
    met = keys.join(lowest, ["s", "k"]).where(F.col("c") != F.col("b")).select(F.col("c").alias("a"), "b")
    return in_place.unionByName(met).distinct()


def tube_ids(records: DataFrame, row: str, barcode: str, accession: str) -> DataFrame:
    """(row, code, tube): the standard barcode of each record and the tube it belongs to (the smallest barcode of the tube).

    Records with no usable barcode belong to no tube and have no row here.
    """
    narrow = records.select(F.col(f"`{row}`").alias("row"), standard_tube(F.col(f"`{barcode}`")).alias("code"), F.upper(F.trim(F.col(f"`{accession}`"))).alias("scope")).where(F.col("code").isNotNull())
    digits = narrow.select(F.when(F.col("scope") != "", F.col("scope")).alias("scope"), F.regexp_extract("code", "^TB-([0-9]+)$", 1).alias("digits")).where("digits <> ''")
    links = one_error_links(digits, "scope", "digits").select(F.concat(F.lit("TB-"), "a").alias("a"), F.concat(F.lit("TB-"), "b").alias("b"))
    labels = seed_tree_components(links, "a", "b").select(F.col("node").alias("code"), "root")
    return narrow.select("row", "code").join(labels, "code", "left").select("row", "code", F.coalesce("root", "code").alias("tube"))


@dataclass
class Option:
    """One value of a bundle in a group: its gain, the dependent values its rules ask for, and those it holds itself."""

    gain: float
    asks: dict[int, str]
    holds: dict[int, str]


def branch_and_bound(options: list[list[Option]], rules: list[tuple[int, int, float]]) -> list[int]:
    """One option per bundle with the largest total gain, less the penalty of every broken rule.

    `rules` has (determinant's bundle, dependent's bundle, penalty); a rule is broken if the chosen determinant asks for
    another value than the chosen dependent holds. Options come by falling gain. The search goes bundle by bundle; a
    branch ends when its total plus the best gains still open cannot exceed the best full choice. A bundle that no later
    bundle depends on takes the first option that breaks nothing and the better ones before it by gain alone, found by
    value. Among equal totals the first found, so the better-ranked, stays.
    """
    rest = [0.0] * (len(options) + 1)
    for i in range(len(options) - 1, -1, -1):
        rest[i] = rest[i + 1] + options[i][0].gain
    closing = [[k for k, (p, q, _) in enumerate(rules) if max(p, q) == i] for i in range(len(options))]
    opening = [any(min(p, q) == i < max(p, q) for p, q, _ in rules) for i in range(len(options))]
    index: list[dict] = []
    for i, own in enumerate(options):
        # where a single rule closes on this bundle and none opens, the best option of every value is enough
        found: dict = {}
        if len(closing[i]) == 1 and not opening[i] and rules[closing[i][0]][0] != rules[closing[i][0]][1]:
            k = closing[i][0]
            side = "holds" if rules[k][1] == i else "asks"
            for n, o in enumerate(own):
                found.setdefault(getattr(o, side).get(k), n)
        index.append(found)
    best_total, best_choice = float("-inf"), [0] * len(options)
    chosen = [0] * len(options)

    def met(k: int) -> bool:
        p, q, _ = rules[k]
        ask, hold = options[p][chosen[p]].asks.get(k), options[q][chosen[q]].holds.get(k)
        return ask is None or hold is None or ask == hold

    def candidates(i: int):
        if not index[i]:
            return range(len(options[i]))
        k = closing[i][0]
        p, q, _ = rules[k]
        other = options[p][chosen[p]].asks.get(k) if q == i else options[q][chosen[q]].holds.get(k)
        picks = {0, *(index[i][v] for v in (other, None) if v in index[i])}
        return sorted(picks)

    def visit(i: int, total: float) -> None:
        nonlocal best_total, best_choice
        if i == len(options):
            if total > best_total:
                best_total, best_choice = total, list(chosen)
            return
        for n in candidates(i):
            gain = options[i][n].gain
            if total + gain + rest[i + 1] <= best_total:
                break
            chosen[i] = n
            visit(i + 1, total + gain - sum(rules[k][2] for k in closing[i] if not met(k)))

    visit(0, 0.0)
    return best_choice


def best_records(
    records: DataFrame,
    group: str,
    row: str,
    trust: str,
    updated: str,
    bundles: Sequence[Bundle],
    dependencies: Sequence[Dependency] = (),
    least_rows: int = 1,
) -> DataFrame:
    """One surviving record per group: (group, first_row, rows, every bundle field, `<bundle>_row`).

    A bundle comes as a whole from one record. The root of the search takes each bundle from the record that ranks first
    by trust (1 is best, null worst), then latest `updated` (null oldest), then smallest `row`, among records where the
    bundle is usable (default: any field given); its bound is the total trust of these. It is computed for all groups as
    partial aggregates. The value that a determinant goes with is looked up over all records: the one given with most
    trust, then latest, then most often. Groups whose root meets every dependency end there, because nothing can exceed
    the bound. All others branch over their distinct bundle values, of which only the best record for each pair of asked
    and held values is kept, and maximise trust, then recency, with broken dependencies as penalties: larger than any
    total if they bind, smaller than any difference if not. Bundles that no record can give are null. Null groups have no
    survivor; repeated rows change nothing; an empty table gives no rows; row ids may be of any ordered type.
    """
    rank = F.coalesce(F.col(f"`{trust}`").cast("int"), F.lit(2**30))
    late = -F.coalesce(F.unix_micros(F.col(f"`{updated}`").cast("timestamp")), F.lit(-(2**62)))
    named = {f: f"f{i}_{j}" for i, b in enumerate(bundles) for j, f in enumerate(b.fields)}
    usable = [b.usable if b.usable is not None else F.coalesce(*[F.col(f"`{f}`").cast("string") for f in b.fields]).isNotNull() for b in bundles]
    narrow = records.select(
        F.col(f"`{group}`").alias("g"),
        F.struct(rank.alias("rank"), late.alias("late"), F.col(f"`{row}`").alias("row")).alias("order"),
        *[F.coalesce(u, F.lit(False)).alias(f"u{i}") for i, u in enumerate(usable)],
        *[F.col(f"`{f}`").alias(n) for f, n in named.items()],
    ).where(F.col("g").isNotNull())
    stash = Stash(records.sparkSession)
    if dependencies:
        narrow = stash.keep(narrow, "records")  # read once for the root, every rule, and the groups in conflict
    picks = [F.min(F.when(F.col(f"u{i}"), F.struct("order", *[named[f] for f in b.fields]))).alias(f"b{i}") for i, b in enumerate(bundles)]
    chosen = narrow.groupBy("g").agg(F.min("order.row").alias("first_row"), F.count("*").alias("rows"), *picks).where(F.col("rows") >= least_rows)

    def shaped(df: DataFrame, source) -> DataFrame:
        cols = [F.col("g").alias(group), "first_row", "rows"]
        for i, b in enumerate(bundles):
            cols += [source(i, named[f]).alias(f) for f in b.fields] + [source(i, "order.row").alias(f"{b.name}_row")]
        return df.select(*cols)

    if not dependencies:
        return shaped(chosen, lambda i, f: F.col(f"b{i}.{f}"))

    place = {f: (i, named[f]) for i, b in enumerate(bundles) for f in b.fields}
    checked = chosen
    rules = []
    broken = F.lit(False)
    for k, d in enumerate(dependencies):
        (i, x), (j, y) = place[d.determinant], place[d.dependent]
        voted = narrow.where(F.col(f"u{i}") & F.col(f"u{j}") & F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"), F.min("order").alias("o"))
        rule = voted.groupBy("x").agg(F.min(F.struct("o.rank", "o.late", -F.col("n"), "y")).alias("v")).select(F.col("x").alias(f"x{k}"), F.col("v.y").alias(f"y{k}"))
        rule = stash.keep(rule, f"rule{k}")
        rules.append((i, x, j, y, rule, k))
        checked = checked.join(rule, F.col(f"b{i}.{x}") == F.col(f"x{k}"), "left")
        broken = broken | F.coalesce(F.col(f"y{k}") != F.col(f"b{j}.{y}"), F.lit(False))
    checked = stash.keep(checked.withColumn("broken", broken), "checked")
    at_root = shaped(checked.where(~F.col("broken")), lambda i, f: F.col(f"b{i}.{f}"))

    # of the groups in conflict: for each bundle, asked and held values, the best record
    hard = stash.keep(narrow.join(checked.where("broken").select("g"), "g", "left_semi"), "conflicts")
    stash.drop(narrow)
    options = None
    for i, b in enumerate(bundles):
        part = hard.where(F.col(f"u{i}")).groupBy("g", *[named[f] for f in b.fields]).agg(F.min("order").alias("o"))
        asks = []
        for ii, x, _, _, rule, k in rules:
            if ii == i:
                part = part.join(rule, F.col(x) == F.col(f"x{k}"), "left").drop(f"x{k}")
                asks += [F.lit(k), F.col(f"y{k}").cast("string")]
        holds = [c for _, _, j, y, _, k in rules if j == i for c in (F.lit(k), F.col(y).cast("string"))]
        text = lambda entries: F.to_json(F.create_map(*entries)) if entries else F.lit(None).cast("string")
        part = part.withColumns({"asks": text(asks), "holds": text(holds)}).groupBy("g", "asks", "holds").agg(F.min("o").alias("o"))
        part = part.select("g", F.lit(i).alias("bundle"), F.col("o.rank").alias("rank"), F.col("o.late").alias("late"), F.col("o.row").alias("row"), "asks", "holds")
        options = part if options is None else options.unionByName(part)
    n_bundles = len(bundles)
    shape = [(i, j, dependencies[k].binding) for i, _, j, _, _, k in rules]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda raw: {int(k): v for k, v in json.loads(raw).items() if v is not None} if raw else {}
        trusts = {r: n + 1 for n, r in enumerate(sorted(pdf["rank"].unique(), reverse=True))}
        times = {t: n for n, t in enumerate(sorted(pdf["late"].unique(), reverse=True))}
        step = 1.0 / ((len(times) + 1) * (n_bundles + 1))  # recency decides only between equal totals of trust
        lists, rows = [], []
        for i in range(n_bundles):
            own = pdf[pdf["bundle"] == i].sort_values(["rank", "late", "row"])
            lists.append([Option(trusts[r] + step * times[t], read(a), read(h)) for r, t, a, h in zip(own["rank"], own["late"], own["asks"], own["holds"], strict=True)] or [Option(0.0, {}, {})])
            rows.append(own["row"].tolist() or [None])
        most = sum(o[0].gain for o in lists) + 1.0
        best = branch_and_bound(lists, [(i, j, most if binding else step / (2 * len(shape) + 2)) for i, j, binding in shape])
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], **{f"r{i}": [rows[i][best[i]]] for i in range(n_bundles)}})

    row_type = narrow.schema["order"].dataType["row"].dataType
    schema = T.StructType([narrow.schema["g"], *[T.StructField(f"r{i}", row_type) for i in range(n_bundles)]])
    solved = stash.keep(options.groupBy("g").applyInPandas(solve, schema), "solved")
    searched = checked.where("broken").select("g", "first_row", "rows").join(solved, "g")
    for i, b in enumerate(bundles):
        wanted = solved.select("g", F.col(f"r{i}").alias("r"))
        given = hard.where(F.col(f"u{i}")).join(wanted, (hard["g"] == wanted["g"]) & (F.col("order.row") == F.col("r")), "left_semi")
        given = given.groupBy("g").agg(F.min(F.struct("order", *[named[f] for f in b.fields])).alias(f"b{i}"))
        searched = searched.join(given, "g", "left")
    return at_root.unionByName(shaped(searched, lambda i, f: F.col(f"b{i}.{f}")))
