"""SQL for the checks of linear models: moments of a table as one matrix, ridge fits by elimination."""

from __future__ import annotations


def moments(source: str, cols: list[str], target: str, by: str | None = None) -> str:
    """The (p + 2) square matrix of sums of products of [columns, target, 1], all centred over the whole source."""
    names = [*cols, target]
    centred = ", ".join(f"{c} - avg({c}) OVER () AS z{i}" for i, c in enumerate(names, 1))
    one = len(names) + 1
    pair = lambda i, j: f"sum(z{min(i, j)} * z{max(i, j)})"
    matrix = ", ".join("[" + ", ".join(pair(i, j) for j in range(1, one + 1)) + "]" for i in range(1, one + 1))
    group = (f"{by}, ", " GROUP BY 1") if by else ("", "")
    return f"SELECT {group[0]}[{matrix}] AS g FROM (SELECT {group[0]}{centred}, 1.0::DOUBLE AS z{one} FROM {source}){group[1]}"


def ridge(g: str, idx: str, p: int, alpha: float = 1.0) -> str:
    """Coefficients of the columns ``idx`` (a list of positions from 1): the normal equations, one column eliminated a step."""
    y, n = p + 1, p + 2
    cov = lambda i, j: f"{g}[{i}][{j}] - {g}[{i}][{n}] * {g}[{j}][{n}] / {g}[{n}][{n}]"
    system = (f"list_transform({idx}, lambda i: list_append(list_transform({idx}, lambda j: {cov('i', 'j')} + CASE WHEN i = j THEN {alpha}::DOUBLE ELSE 0 END), {cov('i', y)}))")
    steps = f"list_transform(range(1, len({idx}) + 1), lambda k: [[CAST(k AS DOUBLE)]])"
    k = "CAST(s[1][1] AS INT)"
    step = (f"lambda m, s: list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda x: x / r[i]) "
            f"ELSE list_transform(r, lambda x, j: x - r[{k}] * m[{k}][j] / m[{k}][{k}]) END)")
    return f"list_transform(list_reduce(list_concat([{system}], {steps}), {step}), lambda r: r[len(r)])"


def _names(cols: list[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in cols) + "]"


def elimination(source: str, cols: list[str], target: str, keep: int) -> str:
    """(feature, coefficient) of the ``keep`` columns left after the smallest coefficient went in every step."""
    p = len(cols)
    ctes = [f"s0 AS (SELECT g, range(1, {p + 1}) AS idx FROM ({moments(source, cols, target)}))"]
    for i in range(p - keep):
        fit = f"(SELECT *, list_transform({ridge('g', 'idx', p)}, lambda x: x * x) AS w FROM s{i})"
        ctes.append(f"s{i + 1} AS (SELECT g, list_filter(idx, lambda x, k: k <> list_position(w, list_min(w))) AS idx FROM {fit})")
    last = f"(SELECT idx, {ridge('g', 'idx', p)} AS w FROM s{p - keep})"
    return ", ".join(ctes) + f" SELECT {_names(cols)}[x.i] AS feature, round(x.w, 8) + 0.0::DOUBLE AS score FROM (SELECT unnest(list_transform(idx, lambda v, k: {{'i': v, 'w': w[k]}})) AS x FROM {last})"


def forward(source: str, cols: list[str], target: str, fold: str, keep: int) -> str:
    """(feature, score) in the order of choice: the column with the best mean R2 over the folds joins in every step."""
    p = len(cols)
    y, n = p + 1, p + 2
    ctes = [f"f AS ({moments(source, cols, target, fold)})",
            f"total AS (SELECT [{', '.join('[' + ', '.join(f'sum(g[{i}][{j}])' for j in range(1, n + 1)) + ']' for i in range(1, n + 1))}] AS t FROM f)",
            "parts AS (SELECT g, list_transform(t, lambda r, i: list_transform(r, lambda x, j: x - g[i][j])) AS h FROM f, total)",
            "p0 AS (SELECT CAST([] AS BIGINT[]) AS picked, CAST(NULL AS DOUBLE) AS score)"]
    dot = "list_sum(list_transform(v, lambda x, i: x * {}))"
    for s in range(keep):
        tried = f"(SELECT picked, c, list_append(picked, c) AS idx FROM p{s}, unnest(range(1, {p + 1})) AS u(c) WHERE NOT list_contains(picked, c))"
        fits = f"(SELECT c, idx, g, h, {ridge('h', 'idx', p)} AS w FROM {tried} CROSS JOIN parts)"
        full = (f"(SELECT c, idx, g, list_append(idx, {n}) AS pos, list_append(w, h[{y}][{n}] / h[{n}][{n}] - list_sum(list_transform(w, lambda x, i: x * h[idx[i]][{n}] / h[{n}][{n}]))) AS v FROM {fits})")
        square = "list_sum(list_transform(v, lambda a, i: list_sum(list_transform(v, lambda b, j: a * b * g[pos[i]][pos[j]]))))"
        r2 = f"1 - (g[{y}][{y}] - 2 * {dot.format(f'g[pos[i]][{y}]')} + {square}) / (g[{y}][{y}] - g[{y}][{n}] * g[{y}][{n}] / g[{n}][{n}])"
        ctes.append(f"p{s + 1} AS (SELECT idx AS picked, avg({r2}) AS score FROM {full} GROUP BY c, idx ORDER BY round(score, 10) DESC, c LIMIT 1)")
    rows = " UNION ALL ".join(f"SELECT {_names(cols)}[picked[{s}]] AS feature, round(score, 8) AS score FROM p{s}" for s in range(1, keep + 1))
    return ", ".join(ctes) + " " + rows


def lasso(source: str, cols: list[str], target: str, alpha: float = 0.01, sweeps: int = 400) -> str:
    """(feature, coefficient) of an L1 fit: the coordinates in turn, a fixed number of sweeps."""
    p = len(cols)
    y, n = p + 1, p + 2
    cov = lambda i, j: f"(g[{i}][{j}] - g[{i}][{n}] * g[{j}][{n}] / g[{n}][{n}]) / g[{n}][{n}]"
    j = "CAST(s[1] AS INT)"
    pull = f"q[{j}][{y}] - list_sum(list_transform(w, lambda v, i: CASE WHEN i = {j} THEN 0.0::DOUBLE ELSE v * q[{j}][i] END))"
    step = f"lambda w, s: list_transform(w, lambda o, k: CASE WHEN k <> {j} THEN o ELSE sign({pull}) * greatest(abs({pull}) - {alpha}::DOUBLE, 0.0::DOUBLE) / q[k][k] END)"
    turns = f"list_transform(range({sweeps * p}), lambda k: [CAST(k % {p} + 1 AS DOUBLE)])"
    return (f"q AS (SELECT list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: {cov('i', 'j')})) AS q FROM ({moments(source, cols, target)})), "
            f"fitted AS (SELECT list_reduce(list_concat([list_transform(range({p}), lambda k: 0.0::DOUBLE)], {turns}), {step}) AS w FROM q) "
            f"SELECT {_names(cols)}[f] AS feature, round(w[f], 8) + 0.0::DOUBLE AS score FROM fitted, unnest(range(1, {p + 1})) AS u(f) WHERE w[f] <> 0")


def permutation(train: str, test: str, cols: list[str], target: str, key: str, number: str, repeats: int = 10, seed: int = 1) -> str:
    """(feature, mean loss of R2 on ``test`` when a column takes another row's values) for a ridge fit on ``train``.

    Rows are numbered by ``number`` of their key and paired with the rows numbered by that of the key with the repeat's mark."""
    p = len(cols)
    values = f"[{', '.join(f'CAST({c} AS DOUBLE)' for c in cols)}]"
    means = f"[{', '.join(f'avg({c})' for c in cols)}]"
    guess = "list_sum(list_transform(x, lambda v, i: (v - mx[i]) * w[i])) + my"
    donors = " UNION ALL ".join(f"SELECT {r} AS rep, x AS o, row_number() OVER (ORDER BY {number.format(key + f' || {chr(39)}#p{seed}.{r}{chr(39)}')}, {key}) AS rn FROM base" for r in range(repeats))
    return f"""fit AS (SELECT {ridge('g', f'range(1, {p + 1})', p)} AS w FROM ({moments(train, cols, target)})), centre AS (SELECT {means} AS mx, avg({target}) AS my FROM {train}),
    base AS (SELECT {key}, x, y, w, {guess} AS guess, row_number() OVER (ORDER BY {number.format(key)}, {key}) AS rn FROM (SELECT {key}, {values} AS x, CAST({target} AS DOUBLE) AS y FROM {test}), fit, centre),
    donors AS ({donors}), plain AS (SELECT sum((guess - y) ** 2) AS e, var_pop(y) * count(*) AS s FROM base),
    lost AS (SELECT f, sum((guess + w[f] * (o[f] - x[f]) - y) ** 2) / {repeats} AS sse FROM base JOIN donors USING (rn), unnest(range(1, {p + 1})) AS u(f) GROUP BY 1)
    SELECT {_names(cols)}[f] AS feature, round((sse - e) / s, 8) + 0.0::DOUBLE AS score FROM lost, plain"""
