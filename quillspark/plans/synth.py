"""Correction data made from the documents table, the same in Spark SQL and DuckDB.

Every document is cut into runs of 16 tokens; none is left out.  A run is a gold
sentence; fixed rules on token places corrupt it into a learner's source and
into four stages of system output, each mending more than the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..shared import spread
from .runs import RUN, RUNS, TABLES, runs_of

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def each(self, arr: str, body: str) -> str:
        """``body`` of every element x at place i (from 0)."""
        if self.duck:
            return f"list_transform({arr}, lambda x, j: {body.replace('{i}', '(j - 1)')})"
        return f"transform({arr}, (x, i) -> {body.replace('{i}', 'i')})"

    def where(self, arr: str, body: str) -> str:
        return f"list_filter({arr}, lambda x: {body})" if self.duck else f"filter({arr}, x -> {body})"

    def array(self, *items: str) -> str:
        if not items:
            return "cast([] as varchar[])" if self.duck else "cast(array() as array<string>)"
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def part(self, arr: str, start: str, count: str) -> str:
        """Elements from ``start`` (from 1)."""
        return f"list_slice({arr}, {start}, ({start}) + ({count}) - 1)" if self.duck else f"slice({arr}, {start}, {count})"

    def at(self, arr: str, i: str) -> str:
        return f"{arr}[({i}) + 1]" if self.duck else f"get({arr}, {i})"

    def size(self, arr: str) -> str:
        return f"len({arr})" if self.duck else f"size({arr})"

    def join(self, arr: str, by: str) -> str:
        return f"array_to_string({arr}, '{by}')" if self.duck else f"array_join({arr}, '{by}')"

    def concat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})" if self.duck else f"concat({a}, {b})"

    def split(self, text: str) -> str:
        pattern = "[ \\t\\r\\n]+" if self.duck else "[ \\\\t\\\\r\\\\n]+"
        return f"string_split_regex({text}, '{pattern}')" if self.duck else f"split({text}, '{pattern}')"

    def explode(self, arr: str, name: str) -> str:
        return f"unnest({arr}) as {name}" if self.duck else f"explode({arr}) as {name}"

    def count_up(self, n: str) -> str:
        """0 to n - 1 (n at least 1)."""
        return f"range(0, {n})" if self.duck else f"sequence(0, {n} - 1)"

    def div(self, a: str, b: str) -> str:
        return f"({a}) // ({b})" if self.duck else f"cast(({a}) div ({b}) as int)"

    def run_id(self, doc: str, c: str) -> str:
        """Number of the c-th run of a document: 2**26 numbers for each, more runs than a text of 2 GB has."""
        return f"{doc} * {RUNS} + {c}"

    def upper(self, x: str) -> str:
        return f"translate({x}, '{_LOWER}', '{_UPPER}')"

    def lower(self, x: str) -> str:
        return f"translate({x}, '{_UPPER}', '{_LOWER}')"


SPARK, DUCK = Dialect(False), Dialect(True)


def tables(d: Dialect) -> str:
    """The WITH list that makes gec, refs, outputs, and equal-length hyp_edit, ref_edit and cand."""
    a = d.array

    def corrupt(drop: bool, double: bool, shout: bool) -> str:
        cases = []
        if drop:
            cases.append(f"when {{i}} % 7 = 3 then {a()}")
        if double:
            cases.append(f"when {{i}} % 11 = 5 then {a('x', 'x')}")
        if shout:
            cases.append(f"when {{i}} % 5 = 2 then {a(d.upper('x'))}")
        body = f"case {' '.join(cases)} else {a('x')} end" if cases else a("x")
        flat = f"flatten({d.each('sw', body)})"
        moved = d.concat(d.part(flat, "2", d.size(flat)), d.part(flat, "1", "1"))
        return f"case when row_id % 10 = 0 then {moved} else {flat} end"

    swap = f"case when {{i}} = row_id % 6 then {d.at('toks', 'row_id % 6 + 1')} when {{i}} = row_id % 6 + 1 then {d.at('toks', 'row_id % 6')} else x end"
    if not d.duck:
        swap = swap.replace("row_id % 6", "cast(row_id % 6 as int)")
    swapped = f"case when {d.size('toks')} > row_id % 6 + 1 then {d.each('toks', swap)} else toks end"

    def shout(arr: str, when: str) -> str:
        return d.each(arr, f"case when {when} then {d.upper('x')} else x end")

    def segment(rule: str) -> str:
        glued = d.each("toks", f"concat(x, case when {{i}} % 4 = {rule} then '' else ' ' end)")
        return f"trim({d.join(glued, '')})"

    words = d.where(d.split("text"), "x <> ''")
    stages = " union all ".join(f"select row_id, ds, {k} as stage, t{k} as hyp, e{k} as eq from gec" for k in range(4))
    refs = " union all ".join(f"select row_id, ds, {k} as ref_id, r{k} as ref, q{k} as eq from gec where row_id % 3 >= {k}" for k in range(3))
    kind = f"case when {d.lower('corr')} = {d.lower('was')} then 'R' else 'W' end"
    places = d.count_up(d.size("esrc"))

    def positional(table: str, name: str, key: str) -> str:
        return (
            f"{name} as (select row_id, ds, {key}, i, corr, {kind} as cat from (select t.row_id, t.ds, t.{key}, p.i, {d.at('t.eq', 'p.i')} as corr, {d.at('p.esrc', 'p.i')} as was "
            f"from {table} t join places p on t.row_id = p.row_id) x where corr <> was)"
        )

    return f"""
        worded as (select doc_id, lang as ds, {words} as w from documents where text is not null),
        cut as (select doc_id, ds, w, {d.explode(d.count_up(d.div(f"{d.size('w')} + {RUN - 1}", str(RUN))), 'c')} from worded where {d.size('w')} > 0),
        base as (select {d.run_id('doc_id', 'c')} as row_id, ds, {d.part('w', f'c * {RUN} + 1', str(RUN))} as toks from cut),
        turned as (select row_id, ds, toks, {swapped} as sw from base),
        made as (select row_id, ds, toks, sw, {corrupt(True, True, True)} as src, {corrupt(True, True, False)} as t1,
            {corrupt(True, False, False)} as u2, {corrupt(False, False, False)} as u3, {shout('sw', '{i} % 5 = 2')} as esrc,
            {shout('sw', '{i} % 5 = 2 and {i} % 2 = 1')} as e1 from turned),
        later as (select *, case when row_id % 4 <> 0 then u2 else t1 end as t2, case when row_id % 4 <> 0 then sw else e1 end as e2 from made),
        gec as (select row_id, ds, toks, src, esrc, src as t0, t1, t2, case when row_id % 8 = 1 then u3 else t2 end as t3,
            esrc as e0, e1, e2, case when row_id % 8 = 1 then toks else e2 end as e3,
            toks as r0, {d.where('toks', 'true')} as r1, toks as r2, toks as q0, {shout('toks', '{i} % 9 = 1')} as q1, {shout('toks', '{i} % 9 = 2')} as q2,
            {segment('row_id % 4')} as s1, {segment('(row_id + case when row_id % 5 = 0 then 1 else 0 end) % 4')} as s2,
            {segment('(row_id + case when row_id % 5 = 0 and row_id % 2 = 0 then 2 when row_id % 5 = 0 then 1 else 0 end) % 4')} as s3 from later),
        outputs as ({stages}),
        refs as ({refs}),
        places as (select row_id, esrc, {d.explode(places, 'i')} from gec),
        {positional('outputs', 'hyp_edit', 'stage')},
        {positional('refs', 'ref_edit', 'ref_id')},
        cand as (select o.row_id, o.ds, o.stage, r.ref_id from outputs o join refs r on o.row_id = r.row_id)
    """


def _with_refs(d: Dialect, text: str) -> str:
    """References 1 and 2 lack the tokens at places that their number gives."""
    for k in (1, 2):
        keep = d.each("toks", f"case when {{i}} % 9 = {k} then null else x end")
        text = text.replace(f"{d.where('toks', 'true')} as r1" if k == 1 else "toks as r2", f"{d.where(keep, 'x is not null')} as r{k}")
    return text


def spark_tables() -> str:
    return _with_refs(SPARK, tables(SPARK))


def duck_tables() -> str:
    return _with_refs(DUCK, tables(DUCK))


_STAGES = "inline(array(" + ", ".join(f"named_struct('stage', {k}, 'hyp', t{k}, 'eq', e{k})" for k in range(4)) + "))"
_REFS = "inline(filter(array(" + ", ".join(f"named_struct('ref_id', {k}, 'ref', r{k}, 'eq', q{k})" for k in range(3)) + "), z -> row_id % 3 >= z.ref_id))"


def _edited(rows: str, key: str) -> str:
    kind = f"case when {SPARK.lower('corr')} = {SPARK.lower('was')} then 'R' else 'W' end"
    return (
        f"select row_id, ds, {key}, i, corr, {kind} as cat from (select row_id, ds, {key}, i, corr, get(esrc, i) as was "
        f"from (select row_id, ds, esrc, {rows} from gec) lateral view posexplode(eq) p as i, corr) where corr <> was"
    )


#: The same tables as in ``tables``, each from one pass over the documents, without joins.
_VIEWS = {
    "gec": "select * from gec",
    "outputs": f"select row_id, ds, {_STAGES} from gec",
    "refs": f"select row_id, ds, {_REFS} from gec",
    "cand": f"select row_id, ds, stage, ref_id from (select row_id, ds, r0, r1, r2, q0, q1, q2, {_STAGES} from gec) lateral view {_REFS} r as ref_id, ref, eq2",
    "hyp_edit": _edited(_STAGES, "stage"),
    "ref_edit": _edited(_REFS, "ref_id"),
}


def _typed(eq: str) -> str:
    """Positional edits of an equal-length side as an array of the engine's edits."""
    kind = f"case when {SPARK.lower('x')} = {SPARK.lower('get(esrc, i)')} then 'R' else 'W' end"
    made = f"named_struct('s0', i, 's1', i + 1, 'kind', {kind}, 'correction', array(x), 'comment', 'NONE')"
    return f"filter(transform({eq}, (x, i) -> case when x <> get(esrc, i) then {made} end), e -> e is not null)"


#: A row for each sentence: its outputs and its references, each with its edits, as arrays.
_VIEWS["nested"] = (
    "select row_id, ds, array(" + ", ".join(f"named_struct('stage', {k}, 'edits', {_typed(f'e{k}')})" for k in range(4)) + ") as outputs, "
    "filter(array(" + ", ".join(f"named_struct('ref_id', {k}, 'edits', {_typed(f'q{k}')})" for k in range(3)) + "), z -> row_id % 3 >= z.ref_id) as refs from gec"
)


def each_batch(spark: SparkSession, sf_dir: str, make: Callable, schema: str) -> DataFrame:
    """``make`` of every batch of runs (:class:`.runs.Runs`) of the documents of ``sf_dir``, a record batch for each."""

    def run(batches):
        for batch in batches:
            for runs in runs_of(batch):
                yield make(runs)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return spread(docs).mapInArrow(run, schema)


def view(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the tables as a DataFrame over the documents of ``sf_dir``; only the given columns, if there are any.

    A row of any table may have columns of its run's row in gec.
    """
    kinds, usual, make = TABLES[name]
    chosen = list(columns or usual)
    return each_batch(spark, sf_dir, lambda runs: make(runs, chosen), ", ".join(f"{c} {kinds[c]}" for c in chosen))


def sql_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as the SQL says it; slow, for tests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return spark.sql(f"with {spark_tables()} {_VIEWS[name]}".replace("from documents", "from {docs}"), docs=docs)


def duck(query: str) -> str:
    return f"with {duck_tables()} {query}"
