"""The words within a class of the language model, by their own vectors.

Every frequent word above a count floor that is no class of its own has an input and an output vector. A class is split
into groups of such words of about equal counts, about as many groups as words in each, and one group of all other words:

    P(word | class, context) = P(group | class, context) * P(word | group, context)

Both factors are softmaxes over one family of nodes, groups of a class or words of a group, of the unigram share times the
exponential of the product of a node's vector and the context's. Families stay small, so they are normalised exactly.
The floor is the cube root of the number of tokens: the vectors grow with the corpus, and each has the examples to learn from.

Training is noise-contrastive: each step sets words of the texts against draws from the unigram of their family. Every
task goes over all of its texts; the changes of a vector are averaged by how often the tasks met it, in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, DRAWS, BATCH, RATE, PASSES = 16, 4, 16384, 0.1, 1

#: Events of a step whose gradients are worked out together.
PIECE = 2048

#: Families of at least so many events in a step, and of at most so many nodes, are worked out as matrices.
SHARED, WIDE = 32, 64

#: The least count of a word with vectors, at the least.
LEAST = 5


def floor_of(tokens: int) -> int:
    return max(LEAST, round(tokens ** (1 / 3)))


@dataclass(frozen=True)
class Tree:
    """Families of nodes: node i has the unigram mass ``mass[i]``, family f the nodes ``first[f]`` up to ``first[f + 1]``.

    Class c has the family ``c`` of its groups, the other words' group first. Word w is the node ``node[w]`` of the family
    ``family[w]``, and its group is the node ``group[w]``.
    """

    mass: np.ndarray
    first: np.ndarray
    node: np.ndarray
    family: np.ndarray
    group: np.ndarray

    def __len__(self) -> int:
        return len(self.node)


def build_tree(classes: int, of_word: np.ndarray, share: np.ndarray, mass: np.ndarray) -> Tree:
    """The tree over words of the classes ``of_word`` with the unigram shares ``share``, for class masses ``mass``."""
    node, family, group = (np.zeros(len(of_word), np.int64) for _ in range(3))
    upper: list[np.ndarray] = []
    lower: list[tuple[np.ndarray, int, int]] = []
    for c in range(classes):
        own = np.flatnonzero(of_word == c)
        own = own[np.argsort(-share[own], kind="stable")]
        parts = np.array_split(own, max(1, round(len(own) ** 0.5))) if len(own) else []
        rest = max(mass[c] - share[own].sum(), mass[c] * 1e-6)
        upper.append(np.array([rest, *(share[p].sum() for p in parts)]))
        lower += [(p, c, k + 1) for k, p in enumerate(parts)]
    sizes = [len(u) for u in upper] + [len(p) for p, _, _ in lower]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for i, (part, c, k) in enumerate(lower):
        family[part] = classes + i
        node[part] = first[classes + i] + np.arange(len(part))
        group[part] = first[c] + k
    return Tree(np.concatenate([*upper, *(share[p] for p, _, _ in lower)]), first, node, family, group)


@dataclass(frozen=True)
class Events:
    """Choices of a node in a family after a context of two symbols, and the token that made each."""

    token: np.ndarray
    far: np.ndarray
    near: np.ndarray
    family: np.ndarray
    node: np.ndarray


def events(tree: Tree, word: np.ndarray, classes: np.ndarray, offsets: np.ndarray, before: int) -> Events:
    """The choices of all tokens: ``word`` is a token's word with vectors, or -1, and texts begin at ``offsets``."""
    symbol = np.where(word >= 0, word, len(tree) + classes)
    near = np.concatenate([[0], symbol])[:-1]
    near[offsets[:-1]] = len(tree) + before
    far = np.concatenate([[0], near])[:-1]
    far[offsets[:-1]] = len(tree) + before
    some = np.diff(tree.first) > 1
    upper = np.flatnonzero(some[classes])
    lower = np.flatnonzero(word >= 0)
    lower = lower[some[tree.family[word[lower]]]]
    chosen = word[upper]
    group = tree.first[classes[upper]]
    known = chosen >= 0
    group[known] = tree.group[chosen[known]]
    token = np.concatenate([upper, lower])
    family = np.concatenate([classes[upper], tree.family[word[lower]]])
    return Events(token, far[token], near[token], family, np.concatenate([group, tree.node[word[lower]]]))


@dataclass(frozen=True)
class Vectors:
    """Vectors of the symbols two words and one word before, and of the nodes, as the rows of one array."""

    rows: np.ndarray
    symbols: int

    @staticmethod
    def start(tree: Tree, classes: int) -> Vectors:
        symbols = len(tree) + classes + 1
        rows = np.random.default_rng(11).normal(0, 0.3, (2 * symbols + len(tree.mass), SIZE)).astype(np.float32)
        rows[2 * symbols :] = 0.0
        return Vectors(rows, symbols)

    def context(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        # Rows are copied whole by take(); an index in brackets copies them number by number.
        return self.rows.take(far, axis=0) + self.rows.take(self.symbols + near, axis=0)

    def nodes(self) -> np.ndarray:
        return self.rows[2 * self.symbols :]


def _small(numbers: np.ndarray, most: int) -> np.ndarray:
    """Numbers up to ``most`` in the least type for them: integers of 16 bits are sorted without comparing."""
    return numbers.astype(np.min_scalar_type(most))


def log_gains(tree: Tree, vectors: Vectors, found: Events, tokens: int) -> np.ndarray:
    """Per token log10 P(word | class, context) less that of the unigram, normalised over every family."""
    gains = np.zeros(tokens)
    order = np.argsort(_small(found.family, len(tree.first)), kind="stable")
    families, begin = np.unique(found.family[order], return_index=True)
    token, far, near, node = (x.take(order) for x in (found.token, found.far, found.near, found.node))
    priors = np.log(tree.mass / np.repeat(np.add.reduceat(tree.mass, tree.first[:-1]), np.diff(tree.first))).astype(np.float32)
    end = np.append(begin, len(order))[1:]
    for f, a, b in zip(families.tolist(), begin.tolist(), end.tolist(), strict=True):
        low, high = int(tree.first[f]), int(tree.first[f + 1])
        own = vectors.nodes()[low:high]
        for c in range(a, b, PIECE):
            d = min(c + PIECE, b)
            # A row per node: families are small, so that sums down the columns run over long rows.
            product = own @ vectors.context(far[c:d], near[c:d]).T
            chosen = product[node[c:d] - low, np.arange(d - c)].astype(np.float64)
            product += priors[low:high, None]
            top = product.max(axis=0)
            product -= top
            total = np.exp(product, out=product).sum(axis=0)
            gains[token[c:d]] += (chosen - top - np.log(total)) / np.log(10)
    return gains


def _slopes(margin: np.ndarray) -> np.ndarray:
    """The loss by the margin of each event's nodes, its own node first."""
    slope = 1.0 / (1.0 + np.exp(-np.clip(margin - np.float32(np.log(margin.shape[1] - 1)), -30, 30)))
    slope[:, 0] -= 1.0
    return slope


def _shared_gradient(tree: Tree, own: np.ndarray, families: np.ndarray, ends: np.ndarray, nodes: np.ndarray, context: np.ndarray, back: np.ndarray):
    """The nodes of some families, and their gradients, one row each; ``back`` gets those of the contexts.

    Events lie family by family up to ``ends``. Events by nodes is a matrix, in which those that were not drawn stay zero.
    """
    begins, low, high = np.append(0, ends)[:-1], tree.first[families], tree.first[families + 1]
    stops = np.cumsum((ends - begins) * (high - low))
    starts = np.append(0, stops)[:-1]
    of_event = np.repeat(np.arange(len(families)), ends - begins)
    cell = (starts - low - begins * (high - low))[of_event] + np.arange(len(nodes)) * (high - low)[of_event]
    cell = (cell[:, None] + nodes).ravel()
    bounds = list(zip(begins.tolist(), ends.tolist(), low.tolist(), high.tolist(), starts.tolist(), stops.tolist(), strict=True))
    product = np.empty(stops[-1], np.float32)
    for a, b, c, d, e, f in bounds:
        np.matmul(context[a:b], own[c:d].T, out=product[e:f].reshape(b - a, d - c))
    slope = _slopes(product.take(cell).reshape(nodes.shape))
    product = np.bincount(cell, slope.ravel(), len(product)).astype(np.float32)
    gradients = []
    for a, b, c, d, e, f in bounds:
        slope = product[e:f].reshape(b - a, d - c)
        np.matmul(slope, own[c:d], out=back[a:b])
        gradients.append(slope.T @ context[a:b])
    return np.concatenate([np.arange(c, d) for _, _, c, d, _, _ in bounds]), np.concatenate(gradients)


def nce_gradient(tree: Tree, vectors: Vectors, found: Events, at: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their gradients of the loss of some events, each against its row of ``drawn`` nodes.

    Small families with many events have a row per node, summed as products of matrices; others a row per event and node.
    The gradients lie in memory one dimension after the other, as they are summed.
    """
    family = found.family.take(at)
    width, events = np.diff(tree.first), np.bincount(family, minlength=len(tree.first) - 1)
    shared = (events >= SHARED) & (width <= WIDE)
    # Families of matrices first, each together.
    place = np.where(shared, np.arange(len(shared)), len(shared))
    order = np.argsort(_small(place, len(shared)).take(family), kind="stable")
    at, drawn = at.take(order), drawn.take(order, axis=0)
    families = np.flatnonzero(shared)
    ends = np.cumsum(events[families])
    single = int(ends[-1]) if len(ends) else 0
    far, near = found.far.take(at), vectors.symbols + found.near.take(at)
    nodes = np.concatenate([found.node.take(at)[:, None], drawn], axis=1)
    context = vectors.context(far, near - vectors.symbols)
    back = np.empty(context.shape, np.float32)
    together, of_together = np.zeros(0, np.int64), np.zeros((0, context.shape[1]), np.float32)
    if single:
        together, of_together = _shared_gradient(tree, vectors.nodes(), families, ends, nodes[:single], context[:single], back[:single])
    nodes, context = nodes[single:] + 2 * vectors.symbols, context[single:]
    count, (pairs, size) = len(at), context.shape
    gradients = np.empty((size, 2 * count + len(together) + nodes.size), np.float32)
    gradients[:, 2 * count : 2 * count + len(together)] = of_together.T
    for_nodes = gradients[:, 2 * count + len(together) :].reshape(size, nodes.shape[1], pairs)
    # A few thousand events at a time stay in the processor's cache.
    for a in range(0, pairs, PIECE):
        b = min(a + PIECE, pairs)
        own = vectors.rows.take(nodes[a:b], axis=0)
        slope = _slopes(np.einsum("ekd,ed->ek", own, context[a:b]))
        back[single + a : single + b] = np.einsum("ek,ekd->ed", slope, own)
        np.multiply(np.ascontiguousarray(context[a:b].T)[:, None], np.ascontiguousarray(slope.T), out=for_nodes[:, :, a:b])
    gradients[:, :count] = back.T
    gradients[:, count : 2 * count] = gradients[:, :count]
    return np.concatenate([far, near, 2 * vectors.symbols + together, nodes.T.ravel()]), gradients.T


def _put(table: np.ndarray, rows: np.ndarray, new: np.ndarray) -> None:
    """``table[rows] = new``, a row at a time as one item, without going over its numbers."""
    whole = np.dtype((np.void, table.dtype.itemsize * table.shape[1]))
    np.put(table.view(whole)[:, 0], rows, new.view(whole)[:, 0])


class Learner:
    """Adagrad steps of one task, and how often it met each row."""

    def __init__(self, tree: Tree, vectors: Vectors, seed: int) -> None:
        self.tree, self.given = tree, vectors
        self.now = Vectors(vectors.rows.copy(), vectors.symbols)
        self.square = np.full(vectors.rows.shape, 1e-2, np.float32)
        self.met = np.zeros(len(vectors.rows), np.int64)
        self.met_nodes = self.met[2 * vectors.symbols :]
        self.last = np.zeros(len(vectors.rows), np.int64)
        self.random = np.random.default_rng(seed)
        self.ends = np.concatenate([[0.0], np.cumsum(tree.mass)])
        steps = 4 << len(tree.mass).bit_length()
        self.scale = steps / self.ends[-1]
        self.guess = np.searchsorted(self.ends, np.arange(steps + 1) / self.scale, side="right") - 1
        self.guess = np.minimum(self.guess, len(tree.mass) - 1)

    def place(self, spread: np.ndarray) -> np.ndarray:
        """The node at each place along the masses of all nodes: guessed from equal steps, and searched where that is wrong."""
        found = self.guess.take((spread * self.scale).astype(np.int64), mode="clip")
        wrong = np.flatnonzero((self.ends.take(found) > spread) | (self.ends.take(found + 1) <= spread))
        found[wrong] = np.searchsorted(self.ends, spread[wrong], side="right") - 1
        return found

    def draw(self, family: np.ndarray) -> np.ndarray:
        low, high = self.tree.first.take(family), self.tree.first.take(family + 1)
        start = self.ends.take(low)
        spread = self.random.random((len(family), DRAWS)) * (self.ends.take(high) - start)[:, None] + start[:, None]
        drawn = self.place(spread.ravel()).reshape(spread.shape)
        return np.clip(drawn, low[:, None], high[:, None] - 1)

    def distinct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows, and for each row its number among them, without sorting."""
        place = np.arange(len(rows))
        self.last[rows] = place
        last = self.last[rows]
        chosen = last == place
        return rows[chosen], (np.cumsum(chosen) - 1)[last]

    def learn(self, found: Events) -> None:
        order = self.random.permutation(len(found.token))
        for rows, met in ((found.far, self.met), (found.near, self.met[self.now.symbols :]), (found.node, self.met_nodes)):
            met[: rows.max(initial=-1) + 1] += np.bincount(rows)
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            drawn = self.draw(found.family.take(at))
            rows, gradients = nce_gradient(self.tree, self.now, found, at, drawn)
            values, number = self.distinct(rows)
            summed = np.stack([np.bincount(number, g, len(values)) for g in gradients.T], axis=1).astype(np.float32)
            square = self.square.take(values, axis=0)
            square += summed * summed
            _put(self.square, values, square)
            np.divide(summed, np.sqrt(square, out=square), out=summed)
            summed *= np.float32(-RATE)
            summed += self.now.rows.take(values, axis=0)
            _put(self.now.rows, values, summed)
            self.met_nodes += np.bincount(drawn.ravel(), minlength=len(self.met_nodes))

    def changes(self) -> Iterator[pa.RecordBatch]:
        touched = np.flatnonzero(self.met)
        for a in range(0, len(touched), 50_000):
            at = touched[a : a + 50_000]
            weighted = (self.now.rows[at] - self.given.rows[at]) * self.met[at][:, None].astype(np.float32)
            arrays = [pa.array(at), pa.array(self.met[at]), *(pa.array(np.ascontiguousarray(weighted[:, k])) for k in range(SIZE))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "met", *(f"v{k}" for k in range(SIZE))])


CHANGES = "row long, met long, " + ", ".join(f"v{k} float" for k in range(SIZE))


def averaged(vectors: Vectors, changes: DataFrame) -> Vectors:
    """The vectors after the changes of all tasks."""
    met = F.sum("met")
    summed = changes.groupBy("row").agg(*((F.sum(f"v{k}") / met).cast("float").alias(f"v{k}") for k in range(SIZE))).toArrow()
    rows = vectors.rows.copy()
    if summed.num_rows:
        rows[summed.column("row").to_numpy()] += np.stack([summed.column(f"v{k}").to_numpy() for k in range(SIZE)], axis=1)
    return Vectors(rows, vectors.symbols)
