"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's pieces are its lines, cut after sentences, and long ones again after words whose hash is 0 modulo
``WORD_CUT`` (without blanks: after characters of certain codes), so that a shared passage is cut alike wherever
it stands. A piece's digest is a 40-bit hash with a 10-bit check of it behind.

Digests are dealt to blocks by their low hash bits, about ``PER_BLOCK`` of them or fewer to a block. A block is a
sketch of cells; each of its digests goes to three, one in each third, and a cell is one number: how many digests
(upper bits), and their XOR (50 bits). Sketches subtract cell by cell, so shared digests vanish, and peeling
recovers the rest: a cell with one digest left (count 1 or -1, check right, and one of the digest's own) gives it away, and
it is taken out of its other cells. A cell of several digests may look like one of a digest that was none; that leaves cells
over, empty ones among them, or gives a digest twice, and then doesn't pass for a result. A count that would leave its bits
stays where it is.

A ``fingerprint`` is a string that holds all cells of all blocks, and ``with_likeness`` needs two such strings only. A
block is built so large (twice the cells at each attempt, other hash bits) that it peels to its own digests. Where the
difference of two blocks doesn't peel, both are peeled alone and built larger, and subtracted again; should the last
attempt fail, the two lists of digests are compared, so the result is exact. Blocks keep the work for a digest the same
in long texts. Everything runs on built-in functions, in the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Digests to a block, at most on average; cells of a third at the first attempt; attempts before lists are compared.
PER_BLOCK, THIRD, ATTEMPTS = 2, 4, 6
#: Characters over which a piece is cut again; one in so many words, or character codes, ends a piece there.
LONG, WORD_CUT, CODE_CUT = 200, 16, 32
#: Documents to a bucket of ids, on average, in which a document finds the next.
BUCKET_ROWS = 2_000
_SENTENCE = r"([.!?])[ \t]+|([。！？])"
#: A noncharacter that marks cuts.
_CUT = "﷑"
#: Bits of a digest, of its check, and of a placed cell's place; counts stand above.
_BITS, _CHECK, _PLACE = 50, 10, 8
_ONE = 1 << (_BITS + _PLACE)
_VALUE, _COUNT, _PLACES = (1 << _BITS) - 1, -_ONE, ((1 << _PLACE) - 1) << _BITS
_BLOCK = "struct<a:int,n:int,cells:array<bigint>,d:array<bigint>>"
#: The attempt number of a block that lists its digests, and of one that isn't built yet; digests that a count can hold.
_LISTED, _UNBUILT, _MOST = 99, -1, 30


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# --- pieces -------------------------------------------------------------------


def pieces(text: Column) -> Column:
    """The non-empty pieces of a text, in order."""

    def cut(p: Column) -> Column:
        def word(w: Column) -> Column:
            by_code = F.array_join(F.transform(F.split(w, ""), lambda x: F.when(F.pmod(F.ascii(x), F.lit(CODE_CUT)) == 7, F.concat(x, F.lit(_CUT))).otherwise(x)), "")
            return F.when(F.length(w) > LONG, by_code).when(F.pmod(F.xxhash64(w), F.lit(WORD_CUT)) == 0, F.concat(w, F.lit(_CUT))).otherwise(w)

        return F.when(F.length(p) > LONG, F.split(F.array_join(F.transform(F.split(p, " "), word), " "), _CUT)).otherwise(F.array(p))

    return F.filter(F.flatten(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _SENTENCE, "$1$2\n"), "\n", -1), cut)), lambda p: F.length(p) > 0)


def digests(text: Column) -> Column:
    """The distinct digests of a text's pieces, sorted; none for an empty or null text."""

    def digest(p: Column) -> Column:
        h = F.xxhash64(p).bitwiseAND(F.lit((1 << (_BITS - _CHECK)) - 1))
        return F.shiftleft(h, _CHECK).bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit((1 << _CHECK) - 1)))

    return F.sort_array(F.array_distinct(F.transform(pieces(text), digest)))


# --- sketches, as SQL text ----------------------------------------------------


def _third(a: str) -> str:
    return f"shiftleft({THIRD}L, least({a}, 3))"


def _mixed(v: str, a: str) -> str:
    """The hash that deals a digest to cells: at each attempt another, and never linear, or the XOR of digests that share all cells would
    have these cells too."""
    return f"xxhash64({v}, {a})"


def _cell(q: str, third: int, t: str) -> str:
    """The place within a third of ``t`` cells."""
    return f"(shiftright({q}, {28 + 6 * third}) & ({t} - 1))"


def _built(d: str, a: str) -> str:
    """All cells of a sketch of the digests ``d``, in order."""
    mixed = f"transform({d}, v -> named_struct('v', v, 'q', {_mixed('v', a)}))"
    dealt = f"transform({mixed}, m -> named_struct('v', m.v, 'x', {_cell('m.q', 0, 't')}, 'y', {_cell('m.q', 1, 't')}, 'z', {_cell('m.q', 2, 't')}))"
    thirds = [f"transform(sequence(0L, t - 1), p -> aggregate(filter(e, m -> m.{f} = p), 0L, (s, m) -> (s + {_ONE}L) ^ m.v))" for f in "xyz"]
    return _let("t", _third(a), _let("e", dealt, f"concat({', '.join(thirds)})"))


def _placed(cells: str) -> str:
    """All cells with their places, in order."""
    return f"transform({cells}, (n, i) -> n | shiftleft(cast(i as bigint), {_BITS}))"


def _minus(x: str, y: str) -> str:
    """The placed cells of the difference of two sketches."""
    return _placed(f"zip_with({x}, {y}, (u, v) -> (u - (v & {_COUNT}L)) ^ (v & {_VALUE}L))")


def _peeled(cells: str, a: str, rounds: int = 40) -> str:
    """(cells left, digests recovered) of placed cells; it ends when no cell gives a digest away."""
    pure = f"abs(shiftright(n, {_BITS + _PLACE})) = 1 and (xxhash64(shiftright(n & {_VALUE}L, {_CHECK})) & {(1 << _CHECK) - 1}) = (n & {(1 << _CHECK) - 1})"
    places = lambda q: [f"{_cell(q, k, 'r')} + {k} * r" for k in range(3)]
    at = [f"shiftleft({p}, {_BITS})" for p in places("m.q")]
    found = f"array_distinct(transform(filter(s.cells, n -> {pure}), n -> n & {~_PLACES}L))"
    mixed = f"transform({found}, n -> named_struct('n', n & {_COUNT}L, 'v', n & {_VALUE}L, 'q', {_mixed(f'(n & {_VALUE}L)', a)}))"
    placed = f"transform({mixed}, m -> named_struct('n', m.n, 'v', m.v, 'at', array({', '.join(at)})))"
    # a digest counts if one of the cells that look like it is its own
    own = f"filter({placed}, m -> exists(m.at, p -> array_contains(s.cells, m.n | m.v | p)))"
    here = f"array_contains(m.at, n & {_PLACES}L)"
    out = f"if(abs(shiftright(u, {_BITS + _PLACE})) > {_MOST}, u, (u - m.n) ^ m.v)"
    left = f"transform(s.cells, n -> aggregate(filter(g, m -> {here}), n, (u, m) -> {out}))"
    full = f"n -> (n & {~_PLACES}L) <> 0"
    state = "struct<cells:array<bigint>,ks:array<bigint>,on:boolean>"
    step = _let("g", own, _let("c", left, f"cast(named_struct('cells', c, 'ks', concat(s.ks, transform(g, m -> m.v)), 'on', size(g) > 0 and exists(c, {full})) as {state})"))
    start = f"cast(named_struct('cells', c0, 'ks', array(), 'on', exists(c0, {full})) as {state})"
    rest = f"s -> cast(named_struct('cells', filter(s.cells, {full}), 'ks', s.ks, 'on', s.on) as {state})"
    loop = f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> if(s.on, {step}, s), {rest})"
    # mostly one round gives all: placed anew, each value shifted by its place, they then XOR to what the cells do
    first = f"array_distinct(transform(filter(c0, n -> {pure}), n -> n & {_VALUE}L))"
    again = " ^ ".join(f"shiftleft(m.v, cast({p} as int))" for p in places("m.q"))
    once = f"aggregate(transform(f0, v -> named_struct('v', v, 'q', {_mixed('v', a)})), 0L, (u, m) -> u ^ {again})"
    whole = f"{a} = 0 and {once} = aggregate(c0, 0L, (u, n) -> u ^ shiftleft(n & {_VALUE}L, cast(shiftright(n & {_PLACES}L, {_BITS}) as int)))"
    quick = _let("f0", first, f"if({whole}, cast(named_struct('cells', array(), 'ks', f0, 'on', true) as {state}), {loop})")
    return _let("r", _third(a), _let("c0", cells, quick))


def _dealt(d: str, n: str) -> str:
    """The digests by block, ``n`` (a power of two) in all; halves of the block's bits are dealt one after the other."""
    inner = f"transform(sequence(0L, {n} div w - 1), j -> filter(f, v -> (shiftright(v, {_CHECK} + k) & ({n} div w - 1)) = j))"
    outer = f"flatten(transform(sequence(0L, w - 1), i -> {_let('f', f'filter({d}, v -> (shiftright(v, {_CHECK}) & (w - 1)) = i)', inner)}))"
    return f"if({n} = 1, array({d}), {_let('k', f'cast(floor(log2({n}) / 2) as int)', _let('w', 'shiftleft(1L, k)', outer))})"


def _listed(b: str) -> str:
    """The digests of a block."""
    peel = f"{_peeled(_placed(b + '.cells'), b + '.a')}.ks"
    return f"if({b}.d is not null, {b}.d, if({b}.a = {_LISTED} or size({b}.cells) = 0, {b}.cells, {peel}))"


def _encoded_block(d: str) -> str:
    """The attempt (plus a hundred times the number of digests) and the cells in order; the first alone without digests; or,
    where no attempt peels, the digests themselves."""
    kind = "struct<a:int,cells:array<bigint>,ok:boolean>"
    # most blocks peel in one round, as each digest has a cell of its own
    own = f"size(array_intersect(z, transform(b, v -> v | {_ONE}L))) = size(b)"
    good = f"{own} or size({_peeled(_placed('z'), 'y')}.cells) = 0"
    one = _let("z", _built("b", "y"), f"cast(named_struct('a', y, 'cells', z, 'ok', {good}) as {kind})")
    start = f"cast(named_struct('a', 0, 'cells', array(), 'ok', false) as {kind})"
    tried = f"aggregate(sequence(0, {ATTEMPTS - 1}), {start}, (m, y) -> if(m.ok, m, {one}))"
    raw = f"concat(array({_LISTED}L + 100 * size(b)), b)"
    made = _let("m", tried, f"if(m.ok, concat(array(m.a + 100L * size(b)), m.cells), {raw})")
    return _let("b", d, f"if(size(b) = 0, array(0L), if(size(b) > {_MOST}, {raw}, {made}))")


def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that later filters and projections read as it stands, and don't compute again."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def fingerprint(digests_col: str) -> Column:
    """The sketch of a column of sorted distinct digests as a string (JSON numbers by block); empty without digests."""
    blocks = _let("n", f"if(size(d) <= {PER_BLOCK}, 1L, cast(pow(2, ceil(log2(size(d) / {PER_BLOCK}))) as bigint))", _dealt("d", "n"))
    return F.expr(_let("d", f"`{digests_col}`", f"if(size(d) = 0, '', to_json(transform({blocks}, k -> {_encoded_block('k')})))"))


def _decoded(text: str) -> str:
    """The blocks of a fingerprint that isn't empty."""
    return f"transform(from_json({text}, 'array<array<bigint>>'), l -> cast(named_struct('a', l[0] % 100, 'n', l[0] div 100, 'cells', slice(l, 2, size(l) - 1), 'd', null) as {_BLOCK}))"


def _size(blocks: str) -> str:
    """How many digests the blocks hold."""
    return f"aggregate({blocks}, 0L, (s, b) -> s + b.n)"


def _widened(blocks: str, n: str) -> str:
    """The same digests in ``n`` blocks, not built yet, where the blocks are fewer."""
    every = f"flatten(transform({blocks}, b -> {_listed('b')}))"
    dealt = _let("w0", every, _dealt("w0", n))
    return f"if(size({blocks}) = {n}, {blocks}, transform({dealt}, d -> cast(named_struct('a', {_UNBUILT}, 'n', size(d), 'cells', array(), 'd', d) as {_BLOCK})))"


_FOUND = "struct<n:int,ok:boolean>"
_FAILED = f"cast(named_struct('n', 0, 'ok', false) as {_FOUND})"


def _done(peel: str) -> str:
    return _let("z", peel, f"cast(named_struct('n', size(z.ks), 'ok', size(z.cells) = 0 and size(array_distinct(z.ks)) = size(z.ks)) as {_FOUND})")


def _differing(x: str, y: str) -> str:
    """(how many digests stand in one of two blocks only, whether that is known) from the difference of the cells as they are."""
    cells = lambda b: f"if({b}.d is null, {b}.cells, {_built(b + '.d', 'o')})"
    known = lambda n: f"cast(named_struct('n', {n}, 'ok', true) as {_FOUND})"
    fits = f"o between 0 and {ATTEMPTS - 1} and ({x}.a = o or {x}.d is not null) and ({y}.a = o or {y}.d is not null) and {x}.n <= {_MOST} and {y}.n <= {_MOST}"
    body = _let("o", f"greatest({x}.a, {y}.a)", f"if({fits}, {_done(_peeled(_minus(cells(x), cells(y)), 'o'))}, {_FAILED})")
    return f"case when {x}.n = 0 or {y}.n = 0 then {known(f'{x}.n + {y}.n')} when {x}.cells = {y}.cells and {x}.a = {y}.a and {x}.a >= 0 then {known('0')} else {body} end"


def _retried(lx: str, ly: str) -> str:
    """How many digests stand in one of two lists only, by larger sketches, at last by comparing the lists."""
    again = _done(_peeled(_minus(_built(lx, "o"), _built(ly, "o")), "o"))
    tries = f"aggregate(sequence(1, {ATTEMPTS - 1}), {_FAILED}, (m, o) -> if(m.ok or size({lx}) > {_MOST} or size({ly}) > {_MOST}, m, {again}))"
    return _let("w", tries, f"if(w.ok, w.n, size(array_except({lx}, {ly})) + size(array_except({ly}, {lx})))")


def with_likeness(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """The rows with ``name``: common over all digests (Jaccard) of two columns of fingerprints, from the strings alone.
    Two empty ones are alike; a null is like nothing (null)."""
    equal, empty = f"`{left}` = `{right}`", f"`{left}` = '' or `{right}` = ''"
    trivial = f"{equal} or {empty} or `{left}` is null or `{right}` is null"
    # one column for each step: the analyzer bounds the depth of one expression
    for column, step in (
        ("_fp_p", f"if({trivial}, null, {_decoded(f'`{left}`')})"),
        ("_fp_q", f"if({trivial}, null, {_decoded(f'`{right}`')})"),
        ("_fp_both", f"{_size('_fp_p')} + {_size('_fp_q')}"),
        ("_fp_n", "greatest(size(_fp_p), size(_fp_q))"),
        ("_fp_p", _widened("_fp_p", "_fp_n")),
        ("_fp_q", _widened("_fp_q", "_fp_n")),
        ("_fp_one", f"zip_with(_fp_p, _fp_q, (bx, by) -> {_differing('bx', 'by')})"),
        # the digests of both blocks where the difference is still to be found
        ("_fp_p", f"zip_with(_fp_p, _fp_one, (b, m) -> if(m.ok, null, {_listed('b')}))"),
        ("_fp_q", f"zip_with(_fp_q, _fp_one, (b, m) -> if(m.ok, null, {_listed('b')}))"),
        ("_fp_two", f"zip_with(_fp_p, _fp_q, (lx, ly) -> if(lx is null, 0, {_retried('lx', 'ly')}))"),
        ("_fp_off", "aggregate(_fp_one, 0L, (s, m) -> s + m.n * cast(m.ok as int)) + aggregate(_fp_two, 0L, (s, k) -> s + k)"),
        (name, f"if({equal}, 1.0D, if({empty}, 0.0D, cast(_fp_both - _fp_off as double) / (_fp_both + _fp_off)))"),
    ):
        df = _set(df, column, F.expr(step)) if column == name else df.withColumn(column, F.expr(step))
    return df.drop("_fp_p", "_fp_q", "_fp_both", "_fp_n", "_fp_one", "_fp_two", "_fp_off")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows' ``id``, ``text`` and ``print``, with ``next`` and ``next_print``: text and fingerprint of the row with the
    next id (then text), after the last the first; null ids come first. A single row is its own next.

    Ids are cut at approximate quantiles to buckets of about ``BUCKET_ROWS``; the first row of each bucket
    is also sent to the bucket before, so one shuffle of the texts is enough and no task sees all. Fingerprints are
    made behind the shuffle.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = src.select("id")
    n = ids.count()
    cuts: list = []
    if n > BUCKET_ROWS:  # as many numbers as buckets
        k = min(100_000, n // BUCKET_ROWS)
        found = ids.agg(F.percentile_approx("id", [i / (k + 1) for i in range(1, k + 1)], 10 * (k + 1)).alias("q")).first()["q"]
        cuts = sorted(set(found))
    # the bucket is the number of cuts at or under the id, found by halving
    bucket = F.when(F.col("id").isNull(), 0).otherwise(_rank(F.col("id"), cuts))
    rows = src.withColumn("_bucket", bucket)
    first = rows.groupBy("_bucket").agg(F.min(F.struct("id", F.xxhash64("text").alias("_h"))).alias("m"))
    order = first.select("_bucket", "m").orderBy("_bucket").collect()  # as many rows as buckets
    if not order:
        return src.select("id", "text", *(F.lit(None).cast("string").alias(x) for x in ("print", "next", "next_print")))
    before = {r["_bucket"]: order[i - 1]["_bucket"] for i, r in enumerate(order)}
    last = order[-1]["_bucket"]
    lead = docs.sparkSession.createDataFrame([(r["_bucket"], r["m"]["id"], r["m"]["_h"], before[r["_bucket"]], r["_bucket"] == order[0]["_bucket"]) for r in order], f"_bucket int, _id {dict(src.dtypes)['id']}, _h long, _before int, _wraps boolean")
    on = (rows["_bucket"] == lead["_bucket"]) & rows["id"].eqNullSafe(lead["_id"]) & (F.xxhash64(rows["text"]) == lead["_h"])
    sent = rows.join(F.broadcast(lead), on).select("id", "text", F.col("_before").alias("_bucket"), F.when(F.col("_wraps") & (F.col("_before") == last), 2).otherwise(1).alias("_tail"))
    both = rows.withColumn("_tail", F.lit(0)).unionByName(sent).repartition("_bucket").withColumn("d", digests(F.col("text")))
    both = _set(both, "print", fingerprint("d")).drop("d")
    # within a bucket by id, then hash of the text; the row sent from the next bucket last
    w = W.partitionBy("_bucket").orderBy("_tail", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return both.withColumn("next", F.lead("text").over(w)).withColumn("next_print", F.lead("print").over(w)).where("_tail = 0").select("id", "text", "print", "next", "next_print")


def _rank(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most the value, by a tree of comparisons."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(str(int(c)) for c in cuts)), ",").cast("array<bigint>")
    lo, hi = F.lit(0), F.lit(len(cuts))
    start = F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = F.get(table, mid) <= value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(under, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, halve, lambda s: s["lo"])


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited version's, and the likeness to that and to the next document's.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many of the
    next document's (all, if it has fewer). Null texts are empty. Repeated rows come in any order
    among themselves. Ids must be integers; other columns are ignored; an empty table gives no rows.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    wide = with_next(docs, id_col, text_col).withColumn("edited", edited)
    own = wide.select("id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "print", F.coalesce("next_print", F.lit("")).alias("next_print"), digests(F.col("edited")).alias("d"))
    own = _set(own, "edited_print", fingerprint("d"))
    out = with_likeness(with_likeness(own, "print", "edited_print", "near_edited"), "print", "next_print", "near_next")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")
