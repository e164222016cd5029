"""Search algorithms as SQL: each step a table of a WITH clause, so that DuckDB computes what the engine does.

The first tables are those of queries.BASE: pts (id, v, freq) and cb (cid, c). Vectors have three elements.
"""

from __future__ import annotations

from ..operators.relational import hash_number

TWO52, TWO53 = 1 << 52, 1 << 53


def draw(seed: str) -> int:
    """The number of 52 bits that operators.kmeans.drawn multiplies."""
    return hash_number(seed, "draw")


def d2(a: str, b: str) -> str:
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in (1, 2, 3))


def half_up(sums: str, n: str) -> str:
    """The rounded quotients of s1, s2, s3 (with a prefix) by n."""
    return "[" + ", ".join(f"(2 * {sums}{i} + {n}) // (2 * {n})" for i in (1, 2, 3)) + "]::BIGINT[]"


SUMS = ", ".join(f"sum(v[{i}] * freq)::BIGINT AS s{i}" for i in (1, 2, 3))


class Steps:
    """Collects tables; each method adds some and gives the name of the one it is about."""

    def __init__(self) -> None:
        self.tables: list[str] = []

    def add(self, sql: str) -> str:
        name = f"t{len(self.tables)}"
        self.tables.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def sql(self, last: str) -> str:
        """What follows queries.BASE."""
        return "".join(f", {t}" for t in self.tables) + f" {last}"

    # passes

    def assign(self, book: str, points: str = "pts") -> str:
        """(id, v, freq, cid, d2), the lowest cid at ties."""
        near = f"SELECT id, any_value(v) AS v, any_value(freq) AS freq, min(({d2('p.v', 'b.c')}) * 1024 + b.cid) AS m FROM {points} p, {book} b GROUP BY id"
        return self.add(f"SELECT id, v, freq, (m % 1024)::INT AS cid, m // 1024 AS d2 FROM ({near})")

    def centroids(self, own: str, book: str) -> str:
        sums = f"SELECT cid, sum(freq)::BIGINT AS n, {SUMS} FROM {own} GROUP BY cid"
        return self.add(f"SELECT b.cid, CASE WHEN n IS NULL THEN c ELSE {half_up('s', 'n')} END AS c FROM {book} b LEFT JOIN ({sums}) s ON s.cid = b.cid")

    def error(self, own: str) -> str:
        return self.add(f"SELECT coalesce(sum(d2::HUGEINT * freq), 0) AS e FROM {own}")

    def lloyd(self, book: str, iterations: int, points: str = "pts") -> str:
        """The codebook after so many iterations, or when the error falls no more."""
        own = self.assign(book, points)
        error = self.error(own)
        for _ in range(iterations):
            new = self.centroids(own, book)
            near = self.assign(new, points)
            fresh = self.error(near)
            better = f"(SELECT e FROM {fresh}) < (SELECT e FROM {error})"
            book = self.add(f"SELECT cid, c FROM {new} WHERE {better} UNION ALL SELECT cid, c FROM {book} WHERE NOT {better}")
            own = self.add(f"SELECT * FROM {near} WHERE {better} UNION ALL SELECT * FROM {own} WHERE NOT {better}")
            error = self.add(f"SELECT least((SELECT e FROM {fresh}), (SELECT e FROM {error})) AS e")
        return book

    def history(self, book: str, iterations: int) -> str:
        """The error before each iteration and after the last, while it falls."""
        errors = []
        for _ in range(iterations + 1):
            own = self.assign(book)
            errors.append(self.error(own))
            book = self.centroids(own, book)
        return self.sql(" UNION ALL ".join(f"SELECT {i} AS step, (SELECT e FROM {e})::DOUBLE AS error" + (f", ((SELECT e FROM {errors[i - 1]}) - (SELECT e FROM {e}))::DOUBLE AS gain" if i else ", NULL::DOUBLE AS gain") for i, e in enumerate(errors)))

    def solution(self, book: str) -> str:
        """The query's columns: cid, c0, c1, c2, freq, sse."""
        own = self.assign(book)
        error = self.error(own)
        return self.sql(f"SELECT b.cid::INT AS cid, c[1] AS c0, c[2] AS c1, c[3] AS c2, coalesce(n, 0)::BIGINT AS freq, (SELECT e FROM {error})::DOUBLE AS sse FROM {book} b LEFT JOIN (SELECT cid, sum(freq) AS n FROM {own} GROUP BY cid) s ON s.cid = b.cid")

    # initial codebooks

    def first(self, k: int, seed: str, points: str = "pts") -> str:
        """The first k points by a hash, numbered in that order."""
        return self.add(f"SELECT (row_number() OVER (ORDER BY md5('{seed}|' || id), id) - 1)::INT AS cid, v AS c FROM {points} QUALIFY cid < {k}")

    def mean(self) -> str:
        return self.add(f"SELECT 0 AS cid, {half_up('s', 'n')} AS c FROM (SELECT sum(freq)::BIGINT AS n, {SUMS} FROM pts)")

    def with_last(self, book: str, vector: str) -> str:
        """A codebook with the vector of a one-row query behind it."""
        return self.add(f"SELECT cid, c FROM {book} UNION ALL SELECT (SELECT max(cid) + 1 FROM {book})::INT, v FROM ({vector})")

    def maxmin(self, k: int) -> str:
        book = self.mean()
        for _ in range(k - 1):
            own = self.assign(book)
            book = self.with_last(book, f"SELECT v FROM {own} ORDER BY d2 DESC, id LIMIT 1")
        return book

    def pick(self, part: int, mass: str) -> str:
        """The vector at which the running sum of `mass` (rows id, v, m) passes part / 2^52 of the total."""
        target = f"(SELECT sum(m)::HUGEINT FROM {mass}) * {int(part / TWO52 * TWO53)} // {TWO53}"
        return f"SELECT v FROM (SELECT id, v, sum(m::HUGEINT) OVER (ORDER BY id) AS run FROM {mass}) WHERE run > {target} ORDER BY id LIMIT 1"

    def plus_plus(self, k: int, seed: str) -> str:
        mass = self.add("SELECT id, v, freq AS m FROM pts")
        book = self.add(f"SELECT 0 AS cid, v AS c FROM ({self.pick(draw(f'{seed}/0/0'), mass)})")
        for i in range(1, k):
            own = self.assign(book)
            mass = self.add(f"SELECT id, v, d2 * freq AS m FROM {own}")
            book = self.with_last(book, self.pick(draw(f"{seed}/{i}/0"), mass))
        return book

    def weighted(self, k: int, seed: str) -> str:
        """Without drawing anew, which a vector that comes twice would need."""
        mass = self.add("SELECT id, v, freq AS m FROM pts")
        return self.add(" UNION ALL ".join(f"SELECT {i} AS cid, v AS c FROM ({self.pick(draw(f'{seed}/{i}/0'), mass)})" for i in range(k)))

    def ranked(self, order: str, ranks: list[str]) -> str:
        """The points of some ranks (expressions of n, the number of points) in an order of (expression, id)."""
        rows = self.add(f"SELECT v, row_number() OVER (ORDER BY {order}, id) - 1 AS r FROM pts")
        return self.add(" UNION ALL ".join(f"SELECT {i} AS cid, v AS c FROM {rows} WHERE r = (SELECT {x} FROM (SELECT count(*) AS n FROM pts))" for i, x in enumerate(ranks)))

    def projection(self, k: int, seed: str) -> str:
        two = self.first(2, seed)
        axis = [f"(SELECT a.c[{i}] - b.c[{i}] FROM {two} a, {two} b WHERE a.cid = 0 AND b.cid = 1)" for i in (1, 2, 3)]
        return self.ranked(" + ".join(f"v[{i}] * {a}" for i, a in enumerate(axis, 1)), [f"{i} * (n // {k})" for i in range(k)])

    def sorting(self, k: int, seed: str) -> str:
        one = self.first(1, seed)
        return self.ranked(d2("v", f"(SELECT c FROM {one})"), [f"({i} * n + n // 2) // {k}" for i in range(k)])

    def stratified(self, k: int, seed: str) -> str:
        size = [f"(n // {k})" if i < k - 1 else f"(n - {i} * (n // {k}))" for i in range(k)]
        return self.ranked(number(seed), [f"{i} * (n // {k}) + {draw(f'{seed}/{i}')}::HUGEINT * {s} // {TWO52}" for i, s in enumerate(size)])

    def partition(self, k: int, seed: str, tries: int = 5) -> str:
        spare = self.first(k, seed)
        books = []
        for t in range(tries):
            own = self.add(f"SELECT v, freq, {number(f'{seed}/{t}')} % {k} AS cid FROM pts")
            books.append(self.centroids(own, spare))
        errors = [self.error(self.assign(b)) for b in books]
        best = self.add("SELECT arg_min(t, e * 100 + t) AS t FROM (" + " UNION ALL ".join(f"SELECT {t} AS t, e FROM {x}" for t, x in enumerate(errors)) + ")")
        return self.add(" UNION ALL ".join(f"SELECT cid, c FROM {b} WHERE (SELECT t FROM {best}) = {t}" for t, b in enumerate(books)))

    def luxburg(self, k: int, seed: str) -> str:
        import math

        many = int(k * math.log2(k))
        book = self.first(many, seed)
        own = self.assign(book)
        new = self.centroids(own, book)
        sizes = self.add(f"SELECT b.cid, c, coalesce(n, 0) AS n FROM {new} b LEFT JOIN (SELECT cid, sum(freq) AS n FROM {own} GROUP BY cid) s ON s.cid = b.cid")
        kept = self.add(f"SELECT r AS cid, c FROM (SELECT c, row_number() OVER (ORDER BY n DESC, cid) - 1 AS r FROM {sizes}) WHERE r < (SELECT greatest({k}, count(*) FILTER (n * {many} >= (SELECT sum(freq) FROM pts))) FROM {sizes})")
        chosen = self.add(f"SELECT 0 AS i, cid, c FROM {kept} WHERE cid = (SELECT {draw(seed)}::HUGEINT * count(*) // {TWO52} FROM {kept})")
        for i in range(1, k):
            far = f"SELECT a.cid, a.c, min({d2('a.c', 'b.c')}) AS d FROM {kept} a, {chosen} b WHERE a.cid NOT IN (SELECT cid FROM {chosen}) GROUP BY a.cid, a.c ORDER BY d DESC, a.cid LIMIT 1"
            chosen = self.add(f"SELECT * FROM {chosen} UNION ALL SELECT {i}, cid, c FROM ({far})")
        return self.add(f"SELECT i AS cid, c FROM {chosen}")

    def replaced(self, book: str, j: str, two: str) -> str:
        """Centroid j (a one-row table's cid) replaced by the first of two vectors, the second behind the others."""
        return self.add(f"SELECT b.cid, CASE WHEN b.cid = (SELECT cid FROM {j}) THEN (SELECT c FROM {two} WHERE cid = 0) ELSE b.c END AS c FROM {book} b UNION ALL SELECT (SELECT max(cid) + 1 FROM {book})::INT, c FROM {two} WHERE cid = 1")

    def splitting(self, k: int, seed: str, iterations: int) -> str:
        book = self.mean()
        for size in range(1, k):
            own = self.assign(book)
            j = self.add(f"SELECT cid FROM {own} GROUP BY cid ORDER BY sum(freq) DESC, cid LIMIT 1")
            inside = self.add(f"SELECT id, v, freq FROM {own} WHERE cid = (SELECT cid FROM {j})")
            book = self.replaced(book, j, self.lloyd(self.first(2, f"{seed}/{size}", inside), iterations, inside))
        return book

    # searches

    def swaps(self, k: int, trials: int, iterations: int, seed: str) -> str:
        book = self.lloyd(self.first(k, seed), iterations)
        pool = self.add(f"SELECT row_number() OVER (ORDER BY md5('{seed}/swap|' || id), id) - 1 AS i, v FROM pts QUALIFY i < {trials}")
        for t in range(trials):
            victim = draw(f"{seed}/victim/{t}") * k >> 52
            v = f"(SELECT v FROM {pool} WHERE i = {t})"
            tried = self.add(f"SELECT cid, CASE WHEN cid = {victim} THEN {v} ELSE c END AS c FROM {book}")
            new = self.lloyd(tried, iterations)
            old_e, new_e = self.error(self.assign(book)), self.error(self.assign(new))
            better = f"((SELECT e FROM {new_e}) < (SELECT e FROM {old_e}) AND NOT EXISTS (SELECT 1 FROM {book} WHERE c = {v}))"
            book = self.add(f"SELECT cid, c FROM {new} WHERE {better} UNION ALL SELECT cid, c FROM {book} WHERE NOT {better}")
        return book

    def merge(self, start: str, k: int, merges: int) -> str:
        """Pairwise nearest neighbour from a codebook and its points' weights."""
        own = self.assign(start)
        now = self.add(f"SELECT b.cid, b.c, coalesce(n, 0)::BIGINT AS n FROM {start} b LEFT JOIN (SELECT cid, sum(freq) AS n FROM {own} GROUP BY cid) s ON s.cid = b.cid")
        for _ in range(merges):
            cost = f"CASE WHEN a.n + b.n = 0 THEN 0 ELSE floor(a.n::DOUBLE * b.n / (a.n + b.n) * ({d2('a.c', 'b.c')}) + 0.5) END"
            pair = self.add(f"SELECT a.cid AS a, b.cid AS b, a.n + b.n AS n, CASE WHEN a.n + b.n = 0 THEN a.c ELSE [" + ", ".join(f"(2 * (a.n * a.c[{i}] + b.n * b.c[{i}]) + a.n + b.n) // (2 * (a.n + b.n))" for i in (1, 2, 3)) + f"]::BIGINT[] END AS c FROM {now} a JOIN {now} b ON a.cid < b.cid ORDER BY {cost}, a.cid, b.cid LIMIT 1")
            last = f"(SELECT max(cid) FROM {now})"
            now = self.add(f"SELECT CASE WHEN t.cid = {last} AND p.b < {last} THEN p.b ELSE t.cid END AS cid, CASE WHEN t.cid = p.a THEN p.c ELSE t.c END AS c, CASE WHEN t.cid = p.a THEN p.n ELSE t.n END AS n FROM {now} t, {pair} p WHERE t.cid <> p.b")
        return self.add(f"SELECT cid, c FROM {now}")

    def shrink(self, book: str, steps: int) -> str:
        """Removes the cluster whose points lose least at their second centroids."""
        for _ in range(steps):
            own = self.assign(book)
            second = f"SELECT o.id, min({d2('o.v', 'b.c')}) AS d FROM {own} o JOIN {book} b ON b.cid <> o.cid GROUP BY o.id"
            loss = self.add(f"SELECT o.cid, sum((s.d - o.d2) * o.freq) AS loss FROM {own} o JOIN ({second}) s ON s.id = o.id GROUP BY o.cid")
            gone = self.add(f"SELECT b.cid FROM {book} b LEFT JOIN {loss} l ON l.cid = b.cid ORDER BY coalesce(loss, -1), b.cid LIMIT 1")
            new = self.centroids(own, book)
            book = self.add(f"SELECT (row_number() OVER (ORDER BY cid) - 1)::INT AS cid, c FROM {new} WHERE cid <> (SELECT cid FROM {gone})")
        return book

    def split(self, k: int, rule: str, tune: int, seed: str) -> str:
        """The cluster of the largest error is split by a rule."""
        book = self.first(1, seed)
        for size in range(1, k):
            own = self.assign(book)
            j = self.add(f"SELECT cid FROM {own} GROUP BY cid ORDER BY sum(d2 * freq) DESC, cid LIMIT 1")
            inside = self.add(f"SELECT id, v, freq FROM {own} WHERE cid = (SELECT cid FROM {j})")
            now = self.add(f"SELECT c FROM {book} WHERE cid = (SELECT cid FROM {j})")
            each = lambda f: "[" + ", ".join(f(i) for i in (1, 2, 3)) + "]::BIGINT[]"
            far = lambda c: self.add(f"SELECT v AS c FROM {inside}, {c} x ORDER BY {d2('v', 'x.c')} DESC, id LIMIT 1")
            if rule in ("sigma", "sigmas"):
                step = self.add(f"SELECT any_value(x.c) AS c, {each(lambda i: f'floor(sqrt(sum((v[{i}] - x.c[{i}]) ** 2 * freq)::DOUBLE / sum(freq)) + 0.5)')} AS s FROM {inside}, {now} x")
                two = (f"SELECT c FROM {step}" if rule == "sigma" else f"SELECT {each(lambda i: f'c[{i}] - s[{i}]')} FROM {step}", f"SELECT {each(lambda i: f'c[{i}] + s[{i}]')} FROM {step}")
            elif rule in ("random", "two_random"):
                few = self.first(2, f"{seed}/{size}", inside)
                two = (f"SELECT c FROM {now}", f"SELECT c FROM {few} WHERE cid = 0") if rule == "random" else (f"SELECT c FROM {few} WHERE cid = 0", f"SELECT c FROM {few} WHERE cid = 1")
            else:
                a = far(now)
                middle = lambda x: f"SELECT {each(lambda i: f'(n.c[{i}] + f.c[{i}] + 1) // 2')} FROM {now} n, {x} f"
                if rule == "far":
                    two = f"SELECT c FROM {now}", f"SELECT c FROM {a}"
                elif rule == "mirror":
                    two = middle(a), f"SELECT {each(lambda i: f'(3 * n.c[{i}] - f.c[{i}] + 1) // 2')} FROM {now} n, {a} f"
                else:
                    b = far(a)
                    two = (f"SELECT c FROM {a}", f"SELECT c FROM {b}") if rule == "two_far" else (middle(a), middle(b))
            pair = self.add(f"SELECT 0 AS cid, * FROM ({two[0]}) x(c) UNION ALL SELECT 1, * FROM ({two[1]}) x(c)")
            book = self.replaced(book, j, pair)
            if tune:
                book = self.lloyd(book, tune)
        return book


def number(seed: str) -> str:
    """The number of 52 bits that begins md5 of the seed and the id."""
    return f"('0x' || substr(md5('{seed}|' || id), 1, 13))::BIGINT"
