"""Phrase collocations from a weighted de Bruijn graph.

Its nodes are pairs of words, its edges triples, weighted by their occurrences; an edge leads from its first pair to its
second. Only edges are counted in texts, one at each word: where a piece ends, the missing words of the edge are empty.
The flow out of a node, such ends included, is the count of its pair, and the flow out of all pairs that begin with a
word the count of that word. Chains of nodes through which all flow passes unbranched are one path with one count.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm import common, memory, words

LEAST, COVER, TOP = 10, 50, 2000
UNKNOWN = "und"
BREAKS = words.byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
WORD = ~(BREAKS | words.byte_class((0x20, 0x20), (0x09, 0x09)))
#: Text counted together before it is sent; keys hashed together to choose their range.
BLOCK_BYTES, ROUTE_BYTES, MOVED_BYTES = 4 << 20, 1 << 20, 1 << 18
#: Words whose counts may be sent to every task; more are joined by shuffle.
SENT_WORDS = 200_000
TAB, LINE = 9, 10
#: A key is ``lang \\t word \\t word \\t word``, the language percent-encoded; keys of a row are joined by line ends.
PACKED = "target int, edges binary, edges_counts binary, nodes binary, nodes_counts binary"
GRAPH = "kind string, id long, lang string, w1 string, w2 string, w3 string, a long, flow long"
_PACKED = pa.schema([("target", pa.int32()), *[(c, pa.binary()) for c in ("edges", "edges_counts", "nodes", "nodes_counts")]])
_GRAPH = pa.schema([("kind", pa.string()), ("id", pa.int64()), *[(c, pa.string()) for c in ("lang", "w1", "w2", "w3")], ("a", pa.int64()), ("flow", pa.int64())])


def move(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: np.ndarray, places: np.ndarray) -> None:
    """Copy slices of one byte buffer to places of another, some at a time."""
    begin, ends = 0, np.cumsum(sizes)
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + MOVED_BYTES, side="right")))
        size = sizes[begin:end]
        after = np.cumsum(size)
        within = np.arange(after[-1]) - np.repeat(after - size, size)
        out[within + np.repeat(places[begin:end], size)] = data[within + np.repeat(starts[begin:end], size)]
        begin = end


def as_keys(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Slices of a byte buffer as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    taken = np.empty(offsets[-1], np.uint8)
    move(data, starts, sizes, taken, offsets[:-1])
    return as_keys(taken, offsets)


def buffers(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow array of large_binary, and ``len + 1`` offsets into them."""
    offsets = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
    data = np.frombuffer(keys.buffers()[2], np.uint8) if keys.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def summed(keys: pa.Array, counts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys and their summed counts (exact below 2**53), one each where there are none."""
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, np.bincount(codes, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)


def tabs(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, and the places of the tabs of each key."""
    data, offsets = buffers(keys)
    data = data[:offsets[-1]]
    found = np.flatnonzero(data == TAB)
    found = found[np.searchsorted(found, offsets[0]):]
    return data, offsets, found.reshape(len(keys), -1) if len(keys) else np.zeros((0, 3), np.int64)


def routes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
    """The range of each slice, by a hash of its bytes."""
    out, begin = np.empty(len(starts), np.int64), 0
    with np.errstate(over="ignore"):
        while begin < len(starts):
            end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + ROUTE_BYTES, side="right")))
            part = data[starts[begin]:ends[end - 1]]
            hashes = words.word_hashes(part, starts[begin:end] - starts[begin], ends[begin:end] - starts[begin])
            out[begin:end] = (hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
            begin = end
    return out


def packed(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row per range, from keys, counts and ranges of the edges, and of the nodes if there are any."""
    rows: dict[int, list] = {}
    for kind, (keys, counts, target) in enumerate(parts):
        order = np.argsort(target, kind="stable")
        keys, counts, target = keys.take(pa.array(order)), counts[order], target[order]
        cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])[:len(target)])
        data, offsets = buffers(keys)
        lined = np.full(len(data[:offsets[-1]]) + len(keys), LINE, np.uint8)  # a line end after each key
        move(data, offsets[:-1], np.diff(offsets), lined, offsets[:-1] + np.arange(len(keys)))
        for a, b in zip(cut, [*cut[1:], len(target)], strict=True) if len(target) else ():
            rows.setdefault(int(target[a]), [b""] * 4)[2 * kind:2 * kind + 2] = lined[offsets[a] + a:offsets[b] + b].tobytes(), counts[a:b].astype("<i8").tobytes()
    columns = zip(*[(t, *r) for t, r in rows.items()], strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


def unpacked(table: pa.Table, kind: str) -> tuple[pa.Array, np.ndarray]:
    """Keys and counts of all rows."""
    data = np.frombuffer(b"".join(table[kind].to_pylist()), np.uint8)
    counts = np.frombuffer(b"".join(table[f"{kind}_counts"].to_pylist()), "<i8")
    lines = data == LINE
    offsets = np.concatenate([[0], np.flatnonzero(lines) - np.arange(len(counts))])
    return as_keys(data[~lines], offsets), counts


def block_edges(lang: str, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct edges of some texts of one language, and their counts there."""
    data, offsets = words.flat_bytes(texts)
    data = words.LOWER_ASCII[data]
    starts, ends, bounds = words.spans(data, offsets, WORD)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(BREAKS[data])])
    owner = words.owners(bounds)
    goes_on = np.append((owner[1:] == owner[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]]), False)
    then = np.append(goes_on[1:], False) & goes_on
    # all words with a tab after each, two at the end of a piece: every key is a slice
    size = ends - starts
    place = np.cumsum(size + 2 - goes_on) - (size + 2 - goes_on)
    flat = np.full(place[-1] + size[-1] + 2, TAB, np.uint8)
    move(data, starts, size, flat, place)
    last = np.arange(len(size)) + goes_on + then
    keys, counts = summed(gather(flat, place, place[last] + size[last] + 2 - goes_on - then - place))
    return pc.binary_join_element_wise(pa.scalar(f"{quote(lang, safe='')}\t".encode(), pa.large_binary()), keys, pa.scalar(b"", pa.large_binary())), counts


def _edges(count: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [("lang", "ascending")]))
            langs = batch["lang"].to_pylist()
            for begin, end in words.blocks(batch["text"], BLOCK_BYTES):
                cut = [i for i in range(begin, end) if i == begin or langs[i] != langs[i - 1]]
                found = [block_edges(langs[a], batch["text"][a:b]) for a, b in zip(cut, [*cut[1:], end], strict=True)]
                keys = pa.concat_arrays([k for k, _ in found])
                data, offsets = buffers(keys)
                yield packed([(keys, np.concatenate([c for _, c in found]), routes(data, offsets[:-1], offsets[1:], count))])

    return edges


def _sum_edges(count: int, least: int):
    """Add up the edges of one range; the flow they give their nodes, and those counted often enough, go to the nodes."""
    def add(table: pa.Table) -> pa.Table:
        keys, counts = summed(*unpacked(table, "edges"))
        data, offsets, at = tabs(keys)
        nodes, flow = summed(gather(data, offsets[:-1], at[:, 2] - offsets[:-1]), counts)
        node_data, node_offsets = buffers(nodes)
        often = np.flatnonzero((counts >= least) & (offsets[1:] - at[:, 2] > 1))
        kept = keys.take(pa.array(often))
        data, offsets, at = tabs(kept)
        batch = packed([
            (kept, counts[often], routes(data, offsets[:-1], at[:, 2], count)), (nodes, flow, routes(node_data, node_offsets[:-1], node_offsets[1:], count)),
        ])
        return pa.Table.from_batches([batch], _PACKED)

    return add


def _sum_nodes(least: int):
    """Counts of the pairs of one range from their flow, its share of the counts of words, and its frequent edges."""
    def add(table: pa.Table) -> pa.Table:
        nodes, flow = summed(*unpacked(table, "nodes"))
        data, offsets, at = tabs(nodes)
        single, share = summed(gather(data, offsets[:-1], at[:, 1] - offsets[:-1]), flow)
        often = np.flatnonzero((flow >= least) & (offsets[1:] - at[:, 1] > 1))
        edges, counts = unpacked(table, "edges")
        order = pc.sort_indices(edges)  # the same numbers when a task runs again
        edges, counts = edges.take(order), counts[order.to_numpy()]
        data, offsets, at = tabs(edges)
        source = pc.index_in(gather(data, offsets[:-1], at[:, 2] - offsets[:-1]), value_set=nodes).to_numpy(zero_copy_only=False).astype(np.int64)
        first_id = int(table["target"][0].as_py()) << 40
        return pa.concat_tables([
            _rows("edge", edges, counts, flow[source], first_id), _rows("node", nodes.take(pa.array(often)), flow[often]), _rows("word", single, share),
        ])

    return add


def _rows(kind: str, keys: pa.Array, counts: np.ndarray, flow: np.ndarray | None = None, first_id: int = 0) -> pa.Table:
    data, offsets, at = tabs(keys)
    edges = [offsets[:-1] - 1, *at.T, offsets[1:]] if len(keys) else []
    parts = [gather(data, a + 1, b - a - 1).cast(pa.large_string()).cast(pa.string()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    parts += [pa.nulls(len(keys), pa.string())] * (4 - len(parts))
    numbers = pa.array(np.arange(len(keys)) + first_id, pa.int64())
    return pa.Table.from_arrays([
        pa.array([kind] * len(keys), pa.string()), numbers, *parts, pa.array(counts, pa.int64()),
        pa.nulls(len(keys), pa.int64()) if flow is None else pa.array(flow, pa.int64()),
    ], schema=_GRAPH)


def build_graph(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The weighted graph, written to the shared folder.

    Rows of three kinds: ``edge`` (triples counted ``least`` times or more: a, and flow, the count of the pair it leaves),
    ``node`` (pairs counted as often: a), ``word`` (shares of the count of w1, to be added up). Languages are percent-encoded.
    """
    count = common.partitions(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text_col].alias("text"))
    sent = texts.mapInArrow(memory.bounded("edges", _edges(4 * count)), PACKED)
    flows = sent.groupBy("target").applyInArrow(memory.bounded("edges", _sum_edges(count, least)), PACKED)
    return common.stored(flows.groupBy("target").applyInArrow(memory.bounded("edges", _sum_nodes(least)), GRAPH), "graph")


def unary_paths(edges: DataFrame) -> DataFrame:
    """Edges joined at nodes through which all flow passes: lang, words, a (the count of each of its edges), and the counts
    ``first_pair`` of the node where it begins.

    At such a node one edge brings the whole count and one takes it. A path is never a circle: every piece begins and ends
    somewhere, so some flow enters and leaves. Each round doubles the distance looked back, so a path of n edges takes
    log2(n) rounds, and no path is longer than the longest piece.
    """
    whole = edges.where("a = flow").select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), "a", F.col("id").alias("next"))
    back = common.stored(
        edges.join(whole, ["lang", "w2", "w3", "a"]).select(F.col("next").alias("id"), F.col("id").alias("head"), F.lit(1).alias("place"), F.lit(True).alias("open")),
        "back",
    )
    while not back.where("open").isEmpty():
        further = back.select(F.col("id").alias("head"), F.col("head").alias("before"), F.col("place").alias("more"))
        back = common.stored(back.join(further, "head", "left").select(
            "id", F.coalesce("before", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("before").isNotNull().alias("open"),
        ), "back")
    placed = edges.join(back.select("id", "head", "place"), "id", "left")
    return (
        placed.groupBy(F.coalesce("head", "id").alias("head"))
        .agg(
            F.min(F.struct(F.coalesce("place", F.lit(0)), "lang", "w1", "w2", "flow", "a")).alias("at"),
            F.sort_array(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("place"), "w3"))).alias("rest"),
        )
        .select("at.lang", F.concat(F.array("at.w1", "at.w2"), F.col("rest.w3")).alias("words"), "at.a", F.col("at.flow").alias("first_pair"))
    )


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` collocations of two and three words of each language.

    A-Z is lower-cased; texts are cut into pieces at ``. , ; : ! ?`` and line ends, and those into words at blanks and
    tabs. A phrase counted ``least`` times or more is a candidate. It is cut in two where floor(1000000 a a / (l r)) is
    lowest (a, l, r: counts of phrase, first part, rest; the first such cut). A candidate inside a longer one whose count is
    at least ``cover`` % of its own is left out. Returns lang, rank, phrase, a, l, r, n (all words of the language), score;
    ranked by score and a descending, then phrase in byte order.

    A null language is ``und`` and one with it. Null and empty texts have no words. Repeated rows count as often as they
    stand. An empty table gives an empty result. Other columns are not read. Counts are exact below 2**53, products up to
    38 digits.
    """
    graph = build_graph(docs, least, text_col, lang_col)
    edges, nodes = graph.where("kind = 'edge'").drop("kind"), graph.where("kind = 'node'").select("lang", "w1", "w2", "a")
    shares = graph.where("kind = 'word'")
    counts = common.stored(shares.groupBy("lang", "w1").agg(F.sum("a").alias("f")).where(F.col("f") >= least), "words")
    paths = unary_paths(edges)
    last = F.col("words")[F.size("words") - 1]
    ends = nodes.select("lang", F.col("w1").alias("e1"), F.col("w2").alias("e2"), F.col("a").alias("last_pair"))
    paths = paths.withColumn("e1", F.col("words")[F.size("words") - 2]).withColumn("e2", last).join(ends, ["lang", "e1", "e2"])
    # the only pairs of a path with a count of their own are those at its ends
    paths = common.stored(paths.select("lang", "words", "a", "first_pair", "last_pair"), "paths")
    inside = paths.select("lang", "a", "words", "first_pair", "last_pair", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("i"))
    triples = inside.select(
        "lang", F.array_join(F.slice("words", F.col("i") + 1, 3), " ").alias("phrase"), F.col("words")[F.col("i")].alias("x"), F.col("words")[F.col("i") + 2].alias("z"), "a",
        F.when(F.col("i") == 0, F.col("first_pair")).otherwise(F.col("a")).alias("xy"),
        F.when(F.col("i") == F.size("words") - 3, F.col("last_pair")).otherwise(F.col("a")).alias("yz"),
    )
    held = paths.select("lang", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.struct(F.col("words")[i].alias("w1"), F.col("words")[i + 1].alias("w2")))).alias("p"), F.col("a").alias("longer"))
    held = held.groupBy("lang", "p.w1", "p.w2").agg(F.max("longer").alias("longer"))
    pairs = nodes.join(held, ["lang", "w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {int(cover)} * a").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("w1").alias("x"), F.col("w2").alias("z"), "a", F.lit(None).cast("long").alias("xy"), F.lit(None).cast("long").alias("yz"),
    )
    counts = F.broadcast(counts) if counts.limit(SENT_WORDS + 1).count() <= SENT_WORDS else counts
    found = triples.unionByName(pairs)
    for name, own in (("x", "fx"), ("z", "fz")):
        found = found.join(counts.select("lang", F.col("w1").alias(name), F.col("f").alias(own)), ["lang", name])
    cut = "CAST((1000000 * (CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)))) div (CAST({} AS DECIMAL(19, 0)) * CAST({} AS DECIMAL(19, 0))) AS BIGINT)"
    found = found.withColumn("s1", F.expr(cut.format("fx", "coalesce(yz, fz)"))).withColumn("s2", F.expr(f"CASE WHEN xy IS NOT NULL THEN {cut.format('xy', 'fz')} END"))
    early = F.expr("s2 IS NULL OR s1 <= s2")
    found = found.select(
        "lang", "phrase", "a", F.when(early, F.col("fx")).otherwise(F.col("xy")).alias("l"),
        F.when(early, F.expr("coalesce(yz, fz)")).otherwise(F.col("fz")).alias("r"), F.when(early, F.col("s1")).otherwise(F.col("s2")).alias("score"),
    )
    by_rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    n = shares.groupBy("lang").agg(F.sum("a").alias("n"))
    return found.join(n, "lang").select(F.url_decode("lang").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


_SCORE = "CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST({} AS HUGEINT) * {}) AS BIGINT)"
SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
w AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p)),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM w GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS a FROM w WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS a FROM w WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
longer AS (SELECT lang, x, y, max(a) AS b FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
c AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.a, u.f AS l1, v.f AS r1, NULL AS l2, NULL AS r2
      FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
      LEFT JOIN longer ON longer.lang = f2.lang AND longer.x = f2.x AND longer.y = f2.y WHERE b IS NULL OR 100 * b < {COVER} * f2.a
      UNION ALL
      SELECT f3.lang, concat_ws(' ', f3.x, f3.y, f3.z), f3.a, u.f, q.a, p.a, v.f
      FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z
      JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z),
s AS (SELECT *, {_SCORE.format("l1", "r1")} AS s1, {_SCORE.format("l2", "r2")} AS s2 FROM c),
b AS (SELECT lang, phrase, a, CASE WHEN s2 IS NULL OR s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s2 IS NULL OR s1 <= s2 THEN r1 ELSE r2 END AS r,
             CASE WHEN s2 IS NULL OR s1 <= s2 THEN s1 ELSE s2 END AS score FROM s)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= {TOP}
"""
