"""Embedding near-dedup with one hierarchical navigable small-world graph per shard.

Vectors of one label and dimension are dealt to shards of bounded size. A shard's graph is built once, by
inserting blocks of vectors; the search that inserts a vector is also its query against the shard, and finds
it every neighbour that came before. Where a label has several shards, graphs and vectors are stored in the
shared folder, and every other shard's vectors query each stored graph. Beams are widened until an audit of
the shard, a fixed sample of queries compared with brute force, reaches the asked recall, and for a single
query as long as its whole beam still lies above the threshold. Candidates are verified by cosine in double
precision. A task reports link counts and a spanning forest of what it linked, never the pairs themselves;
the forests are united by connected components.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.graph import connected_components, merged_labels
from foliant.runtime import Scratch, broadcast_if_small, drop_path, fresh_path, materialize

THRESHOLD, SHARD_ROWS, M, EF, BLOCK, AUDIT, NEAREST, RECALL = 0.98, 8192, 20, 96, 256, 128, 10, 0.99
#: what single precision may be off
SLACK = 1e-5


class Hnsw:
    """Graph over the unit rows of a matrix; build and search handle blocks of rows at once.

    With ``watch`` a row's own search, as it is inserted, is also its query against the rows before it: ``met``
    lists the pairs of at least that similarity, ``full`` the rows whose whole beam reached it.
    """

    def __init__(self, rows: np.ndarray, m: int = M, ef: int = EF, seed: int = 10, watch: float | None = None):
        self.rows, self.m, self.watch = rows.astype(np.float32), m, watch
        self.met, self.full = [], np.zeros(len(rows), bool)
        n = len(rows)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int), 8)
        self.top = int(self.level.max()) if n else 0
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(self.top + 1)]
        self.members = np.zeros(self.top + 1, np.int64)
        self.entry = int(self.level.argmax()) if n else 0
        done = 0
        order = np.concatenate([[self.entry], np.delete(np.arange(n), self.entry)]) if n else np.empty(0, int)
        while done < n:
            block = order[done : done + min(BLOCK, max(8, done))]
            self._insert(block, first=done == 0, ef=ef)
            done += len(block)

    def _insert(self, block: np.ndarray, first: bool, ef: int) -> None:
        q = self.rows[block]
        near = q @ q.T  # vectors of one block see each other directly
        np.fill_diagonal(near, -np.inf)
        entry = np.full((len(block), 1), self.entry)
        for k in range(self.top, -1, -1):
            if not first:
                found, sims = self._beam(q, entry, k, ef if k <= self.level[block].max() else 1)
                entry = found[:, :1]
            if k == 0 and self.watch is not None:
                a, b = np.nonzero(np.triu(near >= self.watch))
                self.met.append((block[a], block[b]))
                if not first:
                    a, c = np.nonzero(sims >= self.watch)
                    self.met.append((block[a], found[a, c]))
                    self.full[block] = sims[:, -1] >= self.watch
            here = np.flatnonzero(self.level[block] >= k)
            if not len(here):
                continue
            own = min(self.m, len(here) - 1)
            cand, score = np.full((len(here), 0), -1), np.empty((len(here), 0), np.float32)
            if own > 0:
                part = near[np.ix_(here, here)]
                at = np.argpartition(-part, own - 1, 1)[:, :own]
                cand, score = block[here][at], np.take_along_axis(part, at, 1)
            if not first:
                cand, score = np.hstack([cand, found[here]]), np.hstack([score, sims[here]])
            score = np.where(cand < 0, -np.inf, score)
            chosen = self._choose(cand, score, self.m)
            self.links[k][block[here], : self.m] = chosen
            self._back(k, np.repeat(block[here], self.m), chosen.ravel())

    def _choose(self, cand: np.ndarray, score: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates, near ones first: those nearer to the row than to any chosen one, then the rest."""
        order = np.argsort(-score, 1, kind="stable")[:, : 2 * m]
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        valid = np.isfinite(score)
        x = self.rows[np.maximum(cand, 0)]
        mutual = x @ x.transpose(0, 2, 1)
        kept, n = np.zeros(cand.shape, bool), cand.shape[1]
        for c in range(n):
            blocked = (kept[:, :c] & (mutual[:, c, :c] > score[:, c : c + 1])).any(1) if c else np.zeros(len(cand), bool)
            kept[:, c] = valid[:, c] & ~blocked & (kept.sum(1) < m)
        rank = np.where(kept, 0, np.where(valid, n, 3 * n)) + np.arange(n)
        order = np.argsort(rank, 1)[:, :m]
        out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(cand, order, 1), -1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        """Add links target -> source; a full row keeps a choice of old and new."""
        use = target >= 0
        source, target = source[use], target[use]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, at, n = np.unique(target, return_index=True, return_counts=True)
        table, width = self.links[k], self.links[k].shape[1]
        have = (table[nodes] >= 0).sum(1)
        easy = have + n <= width
        place = np.arange(len(target)) - np.repeat(at, n) + np.repeat(have, n)
        ok = np.repeat(easy, n)
        table[target[ok], place[ok]] = source[ok]
        hard = np.flatnonzero(~easy)
        if len(hard):
            most = int(n[hard].max())
            new = np.full((len(hard), most), -1)
            for r, h in enumerate(hard):
                new[r, : n[h]] = source[at[h] : at[h] + n[h]]
            cand = np.hstack([table[nodes[hard]], new])
            score = (self.rows[np.maximum(cand, 0)] @ self.rows[nodes[hard]][:, :, None])[:, :, 0]
            table[nodes[hard]] = self._choose(cand, np.where(cand < 0, -np.inf, score), width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best found on level k from the entries, best first: row numbers (-1: none) and similarities."""
        nq, n, step = len(q), len(self.rows), max(4, ef // 6)
        seen = np.zeros((nq, n + 1), bool)
        seen[:, n] = True
        ids, sims, open_ = np.full((nq, ef), n), np.full((nq, ef), -np.inf, np.float32), np.zeros((nq, ef), bool)
        r = np.arange(nq)
        entry = np.where(entry < 0, n, entry)[:, :ef]
        for c in range(entry.shape[1]):
            new = ~seen[r, entry[:, c]]
            seen[r[new], entry[new, c]] = True
            ids[new, c], open_[new, c] = entry[new, c], True
            sims[new, c] = np.einsum("ad,ad->a", q[new], self.rows[entry[new, c]])
        live = r
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            live = live[np.isfinite(score.max(1))]
            if not len(live):
                break
            score = np.where(open_[live], sims[live], -np.inf)
            take = min(step, ef)
            at = np.argpartition(-score, take - 1, 1)[:, :take]
            good = np.isfinite(np.take_along_axis(score, at, 1))
            nodes = np.where(good, ids[live[:, None], at], n)
            open_[live[:, None], at] = False
            nb = np.where((nodes < n)[:, :, None], self.links[k][np.minimum(nodes, n - 1)], n).reshape(len(live), -1)
            nb = np.where(nb < 0, n, nb)
            nb.sort(1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = n
            fresh = ~seen[live[:, None], nb]
            nb = np.where(fresh, nb, n)
            seen[live[:, None], nb] = True
            width = max(1, int(fresh.sum(1).max()))
            nb.sort(1)
            nb = nb[:, :width]
            s = (self.rows[np.minimum(nb, n - 1)] @ q[live][:, :, None])[:, :, 0]
            s[nb == n] = -np.inf
            all_ids, all_sims = np.hstack([ids[live], nb]), np.hstack([sims[live], s])
            all_open = np.hstack([open_[live], nb < n])
            best = np.argpartition(-all_sims, ef - 1, 1)[:, :ef]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(ids == n, -1, ids), sims

    def dump(self) -> bytes:
        """The graph as bytes, for :meth:`load`; without the rows, which are given again."""
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"links{k}": t for k, t in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, rows: np.ndarray) -> Hnsw:
        """A graph that can be searched."""
        graph = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            graph.rows, graph.entry = rows.astype(np.float32), int(z["entry"])
            graph.links = [z[f"links{k}"] for k in range(len(z.files) - 1)]
        graph.top = len(graph.links) - 1
        return graph

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the levels with a narrow beam, then ``ef`` wide on level 0."""
        q = q.astype(np.float32)
        entry = np.full((len(q), 1), self.entry)
        for k in range(self.top, 0, -1):
            entry, _ = self._beam(q, entry, k, 4)
        return self._beam(q, entry, 0, min(ef, len(self.rows)))


def _verified(found, q: np.ndarray, rows: np.ndarray, threshold: float):
    for a, b in found:
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            true = np.einsum("ad,ad->a", q[x], rows[y]) >= threshold
            yield x[true], y[true]


def links(graph: Hnsw, rows: np.ndarray, q: np.ndarray, ef: int, threshold: float, scanned: list[int] | None = None):
    """Yields (query numbers, row numbers) of links, block by block, verified in double precision.

    The graph keeps single precision; what it finds a little below the threshold is verified too. A query
    whose whole beam lies above the threshold is searched again with four times the beam. A beam of a
    thirty-second of the shard touches as many links as the shard has vectors: from there on the query
    scans the shard, which is exact; ``scanned`` counts these queries.
    """
    n, near = len(rows), threshold - SLACK
    for at in range(0, len(q), BLOCK):
        todo, width = np.arange(at, min(at + BLOCK, len(q))), ef
        while len(todo):
            if width * 32 >= n and width > ef or width >= n:
                a, b = np.nonzero(q[todo] @ rows.T >= threshold)
                yield todo[a], b
                if scanned is not None:
                    scanned.append(len(todo))
                break
            ids, sims = graph.search(q[todo], width)
            more = sims[:, -1] >= near
            a, c = np.nonzero((sims >= near) & (ids >= 0) & ~more[:, None])
            yield from _verified([(todo[a], ids[a, c])], q, rows, threshold)
            todo, width = todo[more], 4 * width


def audited_beam(
    graph: Hnsw, rows: np.ndarray, q: np.ndarray, ef: int, threshold: float, recall: float, same: bool = False, seed: int = 11
) -> tuple[int, int, int]:
    """The least doubling of ``ef`` at which sampled queries find the asked share of what brute force finds.

    Also how many they found then, of how many. What is audited are the sample's links and, as links are rare,
    its NEAREST nearest neighbours. Where the queries are the rows themselves (``same``), a query's own row is
    neither. Where the next beam would be a thirty-second of the shard, the answer is the shard: its queries
    scan it, which is exact.
    """
    n = len(rows)
    pick = np.random.default_rng(seed).permutation(len(q))[:AUDIT]
    exact = q[pick] @ rows.T
    if same:
        exact[np.arange(len(pick)), pick] = -np.inf
    true, k = exact >= threshold, min(NEAREST, n - same)
    if k > 0:
        np.put_along_axis(true, np.argpartition(-exact, k - 1, 1)[:, :k], True, 1)
    while ef < n:
        ids, _ = graph.search(q[pick], ef)
        got = np.zeros((len(pick), n + 1), bool)
        np.put_along_axis(got, np.where(ids < 0, n, ids), True, 1)
        wanted, hit = int(np.minimum(true.sum(1), ef - same).sum()), int((got[:, :n] & true).sum())
        if hit >= recall * wanted:
            return ef, min(hit, wanted), wanted
        ef = 2 * ef if 64 * ef < n else n
    return n, int(true.sum()), int(true.sum())


class _Within:
    """Links among the rows of one shard, one bit a pair; a link found from either end counts at both."""

    def __init__(self, n: int):
        self.have, self.label = np.zeros((n, -(-n // 8)), np.uint8), np.arange(n)

    def add(self, found) -> None:
        n = len(self.have)
        for a, b in found:
            rows, at = np.unique(a, return_inverse=True)
            hit = np.zeros((len(rows), n), bool)
            hit[at, b] = True
            hit[np.arange(len(rows)), rows] = False
            self.have[rows] |= np.packbits(hit, axis=1)
            self.label = merged_labels(self.label, a, b)

    def _rows(self, at: int, end: int) -> np.ndarray:
        """Links of the rows from at, a multiple of 8, to end, from either side."""
        n = len(self.have)
        back = np.unpackbits(self.have[:, at // 8 : -(-end // 8)], axis=1, count=end - at).T
        return np.unpackbits(self.have[at:end], axis=1, count=n) | back

    def counts(self, copies: np.ndarray) -> np.ndarray:
        """For each row the number of vectors it links with."""
        n = len(copies)
        return np.concatenate([self._rows(at, min(at + BLOCK, n)) @ copies for at in range(0, n, BLOCK)])

    def missed(self, rows: np.ndarray, threshold: float, recall: float, seed: int = 12) -> bool:
        """Whether too many links of a sample of whole blocks of 8 rows are not there."""
        n, true, got = len(rows), 0, 0
        for at in np.random.default_rng(seed).permutation(-(-n // 8))[: AUDIT // 8] * 8:
            end = min(at + 8, n)
            exact = rows[at:end] @ rows.T >= threshold
            exact[np.arange(end - at), np.arange(at, end)] = False
            true += int(exact.sum())
            got += int((exact & self._rows(at, end).astype(bool)).sum())
        return got < recall * true


def shard_links(rows: np.ndarray, threshold: float, recall: float) -> tuple[Hnsw, _Within, tuple[int, int, int, int]]:
    """Graph and links of one shard, and its audit: found, wanted, beam, rows that scanned the shard."""
    graph, within, scanned = Hnsw(rows, watch=threshold - SLACK), _Within(len(rows)), []
    ef, hit, wanted = audited_beam(graph, rows, rows, EF, threshold, recall, True)
    inserted = ef == EF < len(rows)
    if inserted:
        within.add(_verified(graph.met, rows, rows, threshold))
        full = np.flatnonzero(graph.full)
        within.add((full[a], b) for a, b in links(graph, rows, rows[full], 4 * EF, threshold, scanned))
        if within.missed(rows, threshold, recall):
            ef, inserted = 2 * EF, False
    if not inserted:
        within.add(links(graph, rows, rows, ef, threshold, scanned))
    graph.met = []
    return graph, within, (hit, wanted, ef, sum(scanned))


TASK_SCHEMA = "cid long, root long, links long, found long, wanted long, beam long, scanned long, queries long, path string"


def _answers(ids: np.ndarray, label: np.ndarray, counts: np.ndarray, audit: tuple, queries: int, path: str | None) -> pd.DataFrame:
    """Rows with links, and one row (without cid) of the audit."""
    linked = (counts > 0) | (label != np.arange(len(ids)))
    rows = pd.DataFrame({"cid": ids[linked], "root": ids[label[linked]], "links": counts[linked]})
    one = pd.DataFrame([(*audit, queries, path)], columns=["found", "wanted", "beam", "scanned", "queries", "path"])
    out = pd.concat([rows, one], ignore_index=True).reindex(columns=[c.split()[0] for c in TASK_SCHEMA.split(", ")])
    return out.astype({c: "Int64" for c in out.columns if c != "path"})


def unit(rows: list) -> np.ndarray:
    """Unit rows; scaled by the largest component first, so that no norm of finite numbers overflows."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(threshold: float, recall: float, folder: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", kind="stable")
        x, ids, copies = unit(pdf["embedding"].tolist()), pdf["cid"].to_numpy(), pdf["copies"].to_numpy()
        graph, within, audit = shard_links(x, threshold, recall)
        path = None
        if pdf["n_shards"].iloc[0] > 1:
            # a name of this attempt: what a lost attempt has left is named by no row
            task = TaskContext.get()
            path = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}-{key[2]}-{int(ids[0])}.npz"
            fs, base = pafs.FileSystem.from_uri(path)
            fs.create_dir(base.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(base) as f:
                np.savez(f, x=x, ids=ids, copies=copies, graph=np.frombuffer(graph.dump(), np.uint8))
        return _answers(ids, within.label, within.counts(copies), audit, len(ids), path).assign(label=key[0], dim=key[1], shard=key[2])

    return run


def _stored(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hnsw]:
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(base) as f, np.load(io.BytesIO(f.read())) as z:
        return z["x"], z["ids"], z["copies"], Hnsw.load(z["graph"].tobytes(), z["x"])


def _query(threshold: float, recall: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, asks in zip(pdf["path"], pdf["asks"]):
                (rows, ids, copies, graph), (q, q_ids, q_copies, _) = _stored(path), _stored(asks)
                ef, hit, wanted = audited_beam(graph, rows, q, EF, threshold, recall)
                found, label, scanned, n = np.zeros(len(rows) + len(q), np.int64), np.arange(len(rows) + len(q)), [], len(rows)
                for a, b in links(graph, rows, q, ef, threshold, scanned):
                    np.add.at(found, a + n, copies[b])
                    np.add.at(found, b, q_copies[a])
                    label = merged_labels(label, a + n, b)
                yield _answers(np.concatenate([ids, q_ids]), label, found, (hit, wanted, ef, sum(scanned)), len(q), path)

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, recall: float = RECALL
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept, recall, scanned.

    Vectors are compared when their labels are equal and not null and they have the same number of
    components. Vectors that are null, empty or zero, hold null or non-finite components, or have no id,
    link with nothing: n_links 0, component_id their own id, kept (not kept where the id is null).
    Equal vectors form one class that is searched once; a cosine equal to the threshold links. Rows that repeat
    an id are vectors of their own, so they count as links of each other where they are alike, and differ in
    their components where they are not. Every vector meets every shard of its label, so work grows with rows
    times shards of a label. ``recall`` is what the audits of the vector's label and dimension found of what
    brute force found, ``scanned`` the share of their queries that scanned a shard; both null for vectors that
    are not compared. An empty table gives an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    classes = rows.where("able").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep_id"), F.count("*").alias("copies")
    ).withColumns({"dim": F.size("embedding"), "cid": F.monotonically_increasing_id()})
    classes = materialize(classes, "vectors")  # written before it is read: the numbers hold
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(float(shard_rows))).cast("int").alias("n_shards"))
    dealt = classes.join(broadcast_if_small(shards), ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("embedding"), F.col("n_shards")).cast("int")
    )
    kind = dict(classes.dtypes)["label"]
    folder = fresh_path(spark, "graphs")
    built = dealt.select("label", "dim", "shard", "n_shards", "cid", "copies", "embedding").groupBy("label", "dim", "shard").applyInPandas(
        _build(threshold, recall, folder), f"{TASK_SCHEMA}, label {kind}, dim int, shard int"
    )
    built = scratch.keep(built, "built")
    found, audits = built.drop("shard"), built.where("cid is null")
    graphs = built.where("path is not null").select("label", "dim", "shard", "path")
    n_tasks = graphs.count()
    if n_tasks:
        asks = graphs.select("label", "dim", F.col("shard").alias("a_shard"), F.col("path").alias("asks"))
        pairs = graphs.join(asks, ["label", "dim"]).where("a_shard > shard")
        pairs = pairs.repartition(max(1, min(n_tasks * n_tasks, 20_000)), "path", "asks").select("label", "dim", "path", "asks")
        across = pairs.select("path", "asks").mapInPandas(_query(threshold, recall), TASK_SCHEMA)
        across = scratch.keep(across, "across")
        found = found.drop("label", "dim").unionByName(across)
        audits = audits.unionByName(across.where("cid is null").join(graphs, "path"))
    counts = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("cid <> root"), "cid", "root")
    named = classes.select("label", "embedding", "dim", "copies", "rep_id", "cid").join(counts, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left")
    named = scratch.keep(named.withColumn("comp", F.coalesce("component_id", "cid")).drop("node", "component_id"), "named")
    least = scratch.keep(named.groupBy("comp").agg(F.min("rep_id").alias("least")), "least")
    audits = audits.groupBy(F.col("label").alias("a_label"), F.col("dim").alias("a_dim")).agg(
        (F.sum("found") / F.greatest(F.sum("wanted"), F.lit(1))).alias("r"), F.sum("wanted").alias("w"), (F.sum("scanned") / F.sum("queries")).alias("scanned")
    )
    audits = audits.withColumn("recall", F.when(F.col("w") > 0, F.col("r")).otherwise(1.0)).drop("r", "w")
    solved = named.join(least, "comp").join(broadcast_if_small(audits), (F.col("label") == F.col("a_label")) & (F.col("dim") == F.col("a_dim")))
    solved = materialize(solved.select(
        F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "least", "recall", "scanned",
    ), "solved")
    scratch.drop()
    drop_path(spark, folder)
    on = F.col("able") & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))
    component = F.coalesce("least", "vec_id")
    return rows.join(solved, on, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "recall", "scanned",
    )


def op10_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
