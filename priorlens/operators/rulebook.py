"""Rules as data: a table of rules is compiled into one plan that gives each record the codes of the rules it breaks.

A rule is a code and a test in Spark's SQL over the record's columns, over named lookups (``name.column``) and over shared
values (``{name}``, put in as text). It can hold for some records only (``applies``), and can stop: records that break it
break none of the later ones. A rule is broken unless its test is true, so unknown fails closed.

Lookups are rows of other tables by key. Only those are joined that a rule, a value or another lookup in use refers to, once
each, with only the columns referred to and ``n``, the number of rows of the key; of several rows the least counts. A lookup
that matches nothing is null. Rules over the elements of an array run on exploded elements with lookups of their own; what
they break comes back by a number that each record has been written with, so that repeated records are no trouble. ``gathered``
values of the elements come back as arrays under their names, for rules over the record.

What is shuffled is kept narrow: a rule is tested as soon as all that it (or a stop before it) refers to is there, and goes on
as one bit, and rules over the record that need nothing of the elements are tested before these are exploded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import stored


#: Tables of lookups of the elements with at most so many rows are sent to all tasks.
SMALL_TABLE = 500_000
#: Rules whose outcomes share one number.
BITS = 60


@dataclass(frozen=True)
class Rule:
    code: str
    test: str
    applies: str = "true"
    stops: bool = False
    part: str = ""  # the name of the elements it is about; empty: the record


@dataclass(frozen=True)
class Lookup:
    name: str
    table: str
    on: dict[str, str]  # column of the table: expression over the record and earlier lookups
    part: str = ""


@dataclass(frozen=True)
class Elements:
    name: str
    array: str
    gathered: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Rulebook:
    rules: list[Rule]
    lookups: list[Lookup] = field(default_factory=list)
    values: dict[str, str] = field(default_factory=dict)
    elements: list[Elements] = field(default_factory=list)

    def text(self, expression: str) -> str:
        """With the values put in, which may name others."""
        while found := re.search(r"\{(\w+)\}", expression):
            expression = expression.replace(found[0], f"({self.values[found[1]]})")
        return expression

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as a registry table, in order."""
        rows = [(k, *[getattr(r, f.name) for f in fields(Rule)]) for k, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "place int, code string, test string, applies string, stops boolean, part string")

    def with_rules(self, table: DataFrame) -> Rulebook:
        """The same lookups under the rules of a registry table."""
        rules = [Rule(*[r[f.name] for f in fields(Rule)]) for r in table.orderBy("place").collect()]
        return Rulebook(rules, self.lookups, self.values, self.elements)

    def _used(self, part: str) -> list[tuple[Lookup, list[str]]]:
        """The lookups that something of this part refers to, in order, with the columns referred to. Those of elements whose
        keys are known without the element belong to the record."""
        own = [x for x in self.lookups if x.part == part]
        seen = [x for r in self.rules if r.part == part for x in (r.test, r.applies)]
        seen += [x for e in self.elements if e.name == part for x in e.gathered.values()]
        if part:
            own = [x for x in own if x not in self._of_record(part)]
            of_record = set()
        else:
            of_record = {e.array for e in self.elements}
        text = "\n".join(map(self.text, [*seen, *of_record]))
        used: list[tuple[Lookup, list[str]]] = []
        for lookup in reversed(own):
            columns = sorted(set(re.findall(rf"(?<![\w.]){lookup.name}\.(\w+)", text)))
            if columns or re.search(rf"(?<![\w.]){lookup.name}\b(?!\.)", text):
                used.append((lookup, columns))
                text += "\n" + "\n".join(map(self.text, lookup.on.values()))
        if not part:
            for e in self.elements:
                of = [x for r in self.rules if r.part == e.name for x in (r.test, r.applies)]
                of += [*e.gathered.values(), *[k for x in self.lookups if x.part == e.name for k in x.on.values()]]
                text = "\n".join(map(self.text, of))
                for lookup in self._of_record(e.name):
                    if columns := sorted(set(re.findall(rf"(?<![\w.]){lookup.name}\.(\w+)", text))):
                        used.insert(0, (lookup, columns))
        return used[::-1]

    def _of_record(self, part: str) -> list[Lookup]:
        """Lookups of elements whose keys name neither the element nor another lookup of any part."""
        names = [part, *[x.name for x in self.lookups], *[g for e in self.elements for g in e.gathered]]
        return [x for x in self.lookups if part and x.part == part and not any(self._names(k, names) for k in x.on.values())]

    def _names(self, expression: str, names: Iterable[str]) -> bool:
        """Does it refer to one of the names? Where it only seems so, a rule is tested later than it could be."""
        return any(re.search(rf"(?<![\w.]){re.escape(n)}\b", self.text(expression), re.IGNORECASE) for n in names)

    def _joined(self, df: DataFrame, lookups: list[tuple[Lookup, list[str]]], tables: dict[str, DataFrame], small: bool = False) -> DataFrame:
        """df with the lookups, which have one table and one key."""
        first = lookups[0][0]
        keys = [f"_k{i}" for i in range(len(first.on))]
        own = {x.name: [c for c in columns if c != "n"] for x, columns in lookups}
        rows = [(F.struct(*[F.col(c) for c in cs]) if cs else F.struct(F.lit(0).alias("_none"))).alias(f"_row_{name}") for name, cs in own.items()]
        one = tables[first.table].select(*[F.col(c).alias(k) for c, k in zip(first.on, keys, strict=True)], *rows)
        one = one.groupBy(*keys).agg(*[F.min(f"_row_{name}").alias(f"_row_{name}") for name in own], F.count(F.lit(1)).alias("n"))
        one = one.select(*keys, *[F.struct(*[F.col(f"_row_{name}.{c}").alias(c) for c in cs], F.col("n")).alias(name) for name, cs in own.items()])
        df = df.withColumns({f"_l{i}": F.expr(self.text(e)) for i, e in enumerate(first.on.values())})
        on = [F.col(f"_l{i}") == F.col(k) for i, k in enumerate(keys)]
        return df.join(F.broadcast(one) if small else one, on, "left").drop(*[f"_l{i}" for i in range(len(keys))], *keys)

    def _late(self) -> set[str]:
        """Names that records have only when their elements are done: what is gathered, and lookups by it."""
        late = {g for e in self.elements for g in e.gathered}
        for x in self.lookups:
            if not x.part and any(self._names(k, late) for k in x.on.values()):
                late.add(x.name)
        return late

    def looked_up(self, df: DataFrame, tables: dict[str, DataFrame], *, late: bool = False, have: Iterable[str] = ()) -> DataFrame:
        """df with the lookups of records that need nothing of the elements (with ``late``: the others), but for those it has.
        Where an array of a record is joined to it, this can be done before: the array isn't shuffled for the lookups then."""
        names, alike = self._late(), {}
        for x, columns in self._used(""):
            if x.name not in have and (x.name in names) == late:
                # lookups of one key are one join, unless that key comes from a lookup
                chained = any(self._names(k, [y.name for y in self.lookups]) for k in x.on.values())
                alike.setdefault(x.name if chained else (x.table, *x.on.items()), []).append((x, columns))
        for lookups in alike.values():
            df = self._joined(df, lookups, tables)
        return df

    def _of_elements(self, e: Elements, each: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        """_row, _bits0, ... and the gathered values of every element. Small tables are looked up first, and after each lookup
        what can be tested is."""
        rules = [r for r in self.rules if r.part == e.name]
        todo = self._used(e.name)
        few = {x.name for x, _ in todo if tables[x.table].limit(SMALL_TABLE + 1).count() <= SMALL_TABLE}
        tested, ready, done = 0, {}, {}
        while True:
            waiting = [x.name for x, _ in todo]
            for k, r in enumerate(rules):
                if k in done:
                    continue
                if not self._names(r.test, waiting) and not self._names(r.applies, waiting):
                    passed = reduce(lambda a, b: a & b, [~done[i] for i in range(k) if rules[i].stops], F.lit(True))
                    each = each.withColumn(f"_broken{k}", passed & self._says(r.applies) & ~self._says(r.test))
                    done[k] = F.col(f"_broken{k}")
                elif r.stops:
                    break
            for g, x in e.gathered.items():
                if g not in ready and not self._names(x, waiting):
                    each, ready[g] = each.withColumn(f"_of_{g}", F.expr(self.text(x))), F.col(f"_of_{g}").alias(g)
            if not todo:
                break
            free = [t for t in todo if not any(self._names(k, [n for n in waiting if n != t[0].name]) for k in t[0].on.values())] or todo[:1]
            now = next((t for t in free if t[0].name in few), free[0])
            todo.remove(now)
            each = self._joined(each, [now], tables, now[0].name in few)
        bits = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(done[k], F.lit(1 << k - i).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(i, min(i + BITS, len(rules)))]) for i in range(0, len(rules), BITS)]
        return each.select("_row", *[b.alias(f"_bits{i}") for i, b in enumerate(bits)], *ready.values())

    def _says(self, expression: str) -> Column:
        return F.coalesce(F.expr(self.text(expression)), F.lit(False))

    def check(self, records: DataFrame, tables: dict[str, DataFrame], have: Iterable[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
        """records with ``errors``: the codes of the broken rules, sorted, each once; empty if none is broken. ``have`` names
        the lookups among the columns of records (``looked_up``); ``keep`` the columns to return (all)."""
        columns, late = records.columns if keep is None else list(keep), self._late()
        df = self.looked_up(records, tables, have=have)
        # rules over the record: those before the first stop that has to wait are tested now, as far as they need no elements
        passed, early, rest, waits = F.lit(True), [], [], keep is None  # with all columns kept, there is nothing to gain
        for k, r in enumerate(x for x in self.rules if not x.part):
            if waits or self._names(r.applies, late):
                rest.append((r, None))
                waits |= r.stops
            elif self._names(r.test, late):
                early.append((f"_applies{k}", passed & self._says(r.applies)))
                rest.append((r, f"_applies{k}"))
                waits |= r.stops
            else:
                early.append((f"_broken{k}", passed & self._says(r.applies) & ~self._says(r.test)))
                rest.append((r, f"_broken{k}"))
                if r.stops:
                    passed = passed & (self._says(r.test) | ~self._says(r.applies))
        df = df.withColumns({**dict(early), "_passed": passed})
        more, none = [], F.expr("cast(array() as array<string>)")
        if self.elements:
            # written once, with numbers: what is collected comes in another order when it is computed again
            if keep is not None:
                after = [x for r in self.rules if r.part for x in (r.test, r.applies)] + [x for r, known in rest if known is None or known.startswith("_applies") for x in (r.test, r.applies)]
                after += [x for e in self.elements for x in (e.array, *e.gathered.values())] + [k for x in self.lookups for k in x.on.values()]
                df = df.select(*[c for c in df.columns if c in columns or c.startswith(("_broken", "_applies", "_passed")) or any(self._names(x, [c]) for x in after)])
            df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rulebook-records", compression="zstd")
        base = df
        for e in self.elements:
            each = self._of_elements(e, base.withColumn(e.name, F.explode(e.array)), tables)
            if each.columns == ["_row"]:
                continue
            bits = [c for c in each.columns if c.startswith("_bits")]
            if e.gathered:
                each = each.repartition("_row")  # rows are smaller than half-filled arrays
            found = each.groupBy("_row").agg(*[F.bit_or(b).alias(f"_of_{e.name}{b}") for b in bits], *[F.collect_list(g).alias(g) for g in e.gathered])
            df = df.join(found, "_row", "left")
            for k, r in enumerate(x for x in self.rules if x.part == e.name):
                bit = F.col(f"_of_{e.name}_bits{k // BITS}").bitwiseAND(F.lit(1 << k % BITS).cast("long"))
                more.append(F.when(bit != 0, F.lit(r.code)))
        df = self.looked_up(df, tables, late=True, have=have)
        passed, out = F.col("_passed"), []
        for r, known in rest:
            if known and known.startswith("_broken"):
                out.append(F.when(F.col(known), F.lit(r.code)))
                continue
            test, applies = self._says(r.test), self._says(r.applies) if known is None else F.col(known)
            out.append(F.when(passed & applies & ~test, F.lit(r.code)))
            if r.stops:
                passed = passed & (test | ~applies)
        every = F.concat(F.array_compact(F.array(*out)) if out else none, F.when(passed, F.array_compact(F.array(*more))).otherwise(none) if more else none)
        return df.withColumn("errors", F.array_sort(F.array_distinct(every))).select(*columns, "errors")
