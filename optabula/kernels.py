"""Numpy work inside one Spark task: batch sums, rechunking and the solve of one block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DOUBLES = pa.list_(pa.float64())

# Numbers of one piece of a long vector of sums, and the side of a matrix tile of as many numbers.
PIECE, TILE = 1024, 32
# Pieces in one Arrow batch: 32 MB.
PIECES_AT_ONCE = 4096

# Blocks up to this width are solved with Newton steps, wider ones with quasi-Newton steps.
NEWTON_WIDTH = 256


def as_matrix(column, width):
    """Arrow list column -> (rows, width) float64 view; rejects nulls and ragged rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, width))
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("null vector or null vector element")
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != width or lengths["max"] != width:
        raise ValueError(
            f"vectors of {lengths['min']} to {lengths['max']} values, expected {width}"
        )
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, width)


def as_lists(matrix):
    """(rows, width) array -> Arrow list<double> column."""
    matrix = np.ascontiguousarray(matrix, dtype=np.float64)
    n, width = matrix.shape
    offsets = np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[: n + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def checked_rows(x, y):
    """Refuses NULL (read as NaN), NaN and infinite numbers: one of them shows in the sums."""
    if not np.isfinite(x.sum() + y.sum()):
        raise ValueError("a row is not finite, or lacks its label or target")


def sigmoid(t):
    e = np.exp(-np.abs(t))
    return np.where(t >= 0, 1.0, e) / (1.0 + e)


def loss_and_sigmoid(t):
    """(log(1 + exp(t)), sigmoid(t)) from one exponential, without overflow."""
    e = np.exp(-np.abs(t))
    return np.maximum(t, 0.0) + np.log1p(e), np.where(t >= 0, 1.0, e) / (1.0 + e)


def piece_batches(vectors, keys=None):
    """Rows of sums -> batches ([block_id], piece, values): vectors cut into pieces of PIECE numbers.

    Long vectors move, and are added, piece by piece: no task needs a group's vectors at once.
    """
    vectors = np.ascontiguousarray(vectors, dtype=np.float64)
    k, size = vectors.shape
    n = max(1, -(-size // PIECE))
    cuts = np.minimum(np.arange(n) * PIECE, size)
    starts = np.append((np.arange(k)[:, None] * size + cuts).ravel(), k * size)
    flat = vectors.ravel()
    for lo in range(0, k * n, PIECES_AT_ONCE):
        hi = min(lo + PIECES_AT_ONCE, k * n)
        columns = [
            pa.array((np.arange(lo, hi) % n).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array((starts[lo:hi + 1] - starts[lo]).astype(np.int32)),
                                     pa.array(flat[starts[lo]:starts[hi]]))]
        names = ["piece", "values"]
        if keys is not None:
            owner = np.asarray(keys, dtype=np.int64)[np.arange(lo, hi) // n]
            columns, names = [pa.array(owner), *columns], ["block_id", *names]
        yield pa.RecordBatch.from_arrays(columns, names)


def one_partial(values):
    return piece_batches(np.asarray(values)[None, :])


def _runs(batch):
    """(ids of a run, its lists in one array, its rows) for rows with equal leading columns."""
    ids = np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1)
    lists = batch.column(batch.num_columns - 1)
    ends = lists.offsets.to_numpy()
    ends, flat = ends - ends[0], lists.flatten().to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
        yield tuple(ids[lo].tolist()), flat[ends[lo]:ends[hi]], hi - lo


def add_pieces(keyed):
    """mapInArrow body: rows sorted by ([block_id], piece) -> one row of each, with the sum."""

    def emit(done):
        ids, sums = zip(*done)
        columns = [pa.array([i[-1] for i in ids], pa.int32()), pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, sums)]).astype(np.int32)), pa.array(np.concatenate(sums)))]
        names = ["piece", "values"]
        if keyed:
            columns, names = [pa.array([i[0] for i in ids], pa.int64()), *columns], ["block_id", *names]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        now, total, done = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            for ids, values, n in _runs(batch):
                part = values.reshape(n, -1).sum(axis=0)
                if ids == now:
                    total = total + part
                    continue
                if now is not None:
                    done.append((now, total))
                    if len(done) >= PIECES_AT_ONCE:
                        yield emit(done)
                        done = []
                now, total = ids, part
        if now is not None:
            yield emit([*done, (now, total)])

    return run


def whole_vectors(size, keyed, finish=None):
    """mapInArrow body: summed pieces sorted by ([block_id], piece) -> one row per vector.

    ``finish`` makes columns and names of a (rows, size) array; by default one column, partial.
    """
    most = max(1, (64 << 20) // (8 * size))
    finish = finish or (lambda vectors: ([as_lists(vectors)], ["partial"]))

    def emit(keys, vectors):
        if any(len(v) != size for v in vectors):
            raise ValueError("a sum over rows lacks some of its pieces")
        columns, names = finish(np.stack(vectors))
        if keyed:
            columns, names = [pa.array(keys, pa.int64()), *columns], ["block_id", *names]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        now, parts, keys, vectors = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            for ids, values, _ in _runs(batch):
                key = ids[0] if keyed else 0
                if key != now and now is not None:
                    keys.append(now)
                    vectors.append(np.concatenate(parts))
                    parts = []
                    if len(keys) >= most:
                        yield emit(keys, vectors)
                        keys, vectors = [], []
                now = key
                parts.append(values)
        if now is not None:
            yield emit([*keys, now], [*vectors, np.concatenate(parts)])

    return run


def pack_symmetric(matrix):
    """The tiles of TILE x TILE on and above the diagonal, row by row, as one vector."""
    d = len(matrix)
    n = -(-d // TILE)
    padded = np.zeros((n * TILE, n * TILE))
    padded[:d, :d] = matrix
    return padded.reshape(n, TILE, n, TILE).swapaxes(1, 2)[np.triu_indices(n)].ravel()


def unpack_symmetric(vector, d):
    n = -(-d // TILE)
    i, j = np.triu_indices(n)
    part, tiles = vector.reshape(-1, TILE, TILE), np.empty((n, n, TILE, TILE))
    tiles[j, i] = part.swapaxes(1, 2)
    tiles[i, j] = part
    return tiles.swapaxes(1, 2).reshape(n * TILE, n * TILE)[:d, :d]


def packed_size(d):
    n = -(-d // TILE)
    return n * (n + 1) // 2 * TILE * TILE


def logistic_objective(x, y, models):
    """Summed logistic loss and its gradient for every model; labels 0/1."""
    sign = (1.0 - 2.0 * y)[:, None]
    loss, s = loss_and_sigmoid(sign * (x @ models.T))
    return loss.sum(axis=0), (sign * s).T @ x


def least_squares_objective(x, y, models):
    """Half the summed squared residuals and their gradient for every model."""
    residual = x @ models.T - y[:, None]
    return 0.5 * (residual * residual).sum(axis=0), residual.T @ x


def huber_objective(delta):
    """Squared up to residuals of ``delta``, linear beyond: an objective for targets with outliers."""

    def objective(x, y, models):
        residual = x @ models.T - y[:, None]
        clipped = np.clip(residual, -delta, delta)
        return (clipped * (residual - 0.5 * clipped)).sum(axis=0), clipped.T @ x

    return objective


def checked_objective(objective, x, y, models):
    """The objective's sums of a chunk, with the shapes and numbers that a pass can add up."""
    losses, grads = objective(x, y, models)
    losses, grads = np.asarray(losses, dtype=float), np.asarray(grads, dtype=float)
    if losses.shape != (len(models),) or grads.shape != models.shape:
        raise ValueError(f"an objective gives losses of shape {(len(models),)} and gradients of "
                         f"{models.shape}, not {losses.shape} and {grads.shape}")
    return losses, grads


def objective_partials(objective, candidates):
    """mapInArrow body: [losses, gradients, rows] of one partition, of any objective."""
    d = candidates.shape[1]

    def run(batches):
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = as_matrix(batch.column(0), d), batch.column(1).to_numpy(zero_copy_only=False)
            checked_rows(x, y)
            losses, grads = checked_objective(objective, x, y, candidates)
            total, n = total + np.concatenate([losses, grads.ravel()]), n + len(y)
        if n:
            yield from one_partial(np.append(total, float(n)))

    return run


def segment_partials(objective, models):
    """mapInArrow body: the same for every segment of a partition, each with its own models.

    Input columns are vector, number and segment; segments that ask for no model are passed over.
    """
    d = next(iter(models.values())).shape[1]

    def run(batches):
        totals = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if batch.column(2).null_count:
                raise ValueError("a row has no segment")
            x, y = as_matrix(batch.column(0), d), batch.column(1).to_numpy(zero_copy_only=False)
            checked_rows(x, y)
            keys = batch.column(2).to_numpy()
            order = np.argsort(keys, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                key = int(keys[rows[0]])
                if key in models:
                    losses, grads = checked_objective(objective, x[rows], y[rows], models[key])
                    sums = np.concatenate([losses, grads.ravel(), [float(len(rows))]])
                    totals[key] = totals[key] + sums if key in totals else sums
        for key, sums in totals.items():
            yield from piece_batches(sums[None, :], [key])

    return run


def logistic_partials(candidates, with_gradient):
    """mapInArrow body: [losses, gradients, rows] of one partition for every candidate model."""
    k, d = candidates.shape

    def run(batches):
        losses, grads, n = np.zeros(k), np.zeros((k, d)), 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_matrix(batch.column(0), d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            checked_rows(x, y)
            sign = (1.0 - 2.0 * y)[:, None]
            loss, s = loss_and_sigmoid(sign * (x @ candidates.T))
            losses += loss.sum(axis=0)
            if with_gradient:
                grads += (sign * s).T @ x
            n += len(y)
        if n:
            parts = [losses, grads.ravel()] if with_gradient else [losses]
            yield from one_partial(np.concatenate([*parts, [float(n)]]))

    return run


def array_partials(width):
    """mapInArrow body: element-wise sum of one partition's vectors."""

    def run(batches):
        total, n = np.zeros(width), 0
        for batch in batches:
            total += as_matrix(batch.column(0), width).sum(axis=0)
            n += batch.num_rows
        if n:
            yield from one_partial(total)

    return run


def grouped_partials(chunk_sums, width, size, keyed):
    """mapInArrow body: one vector of sums per group of a partition.

    Input columns are vector, number and (if keyed) group id. Groups are flushed before
    they take more than 64 MB; later partials of the same group just add up downstream.
    """
    max_groups = max(1, (64 << 20) // (8 * size))

    def flush(groups):
        keys = list(groups)
        vectors = np.stack([groups[key] for key in keys])
        groups.clear()
        return piece_batches(vectors, keys if keyed else None)

    def run(batches):
        groups = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a = as_matrix(batch.column(0), width)
            b = batch.column(1).to_numpy(zero_copy_only=False)
            checked_rows(a, b)
            if keyed:
                keys = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(keys, kind="stable")
                pieces = np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)
            else:
                keys, pieces = None, [slice(None)]
            for rows in pieces:
                key = int(keys[rows[0]]) if keyed else 0
                sums = chunk_sums(a[rows], b[rows])
                groups[key] = groups[key] + sums if key in groups else sums
                if len(groups) >= max_groups and keyed:
                    yield from flush(groups)
        if groups:
            yield from flush(groups)

    return run


def gram_sums(weights_at=None):
    """Chunk sums [tiles of A'A, A'b, b'b, n]; with a model, rows are weighted by s(1-s)."""

    def sums(a, b):
        weighted = a
        if weights_at is not None:
            s = sigmoid(a @ weights_at)
            weighted = a * (s * (1.0 - s))[:, None]
        return np.concatenate(
            [pack_symmetric(weighted.T @ a), weighted.T @ b, [b @ b, float(len(b))]])

    return sums


def finish_grams(d):
    """``whole_vectors`` finish: summed tiles -> n_rows, n_cols, ata (row-major), atb, btb."""

    def finish(vectors):
        square = packed_size(d)
        return [
            pa.array(vectors[:, -1].astype(np.int64)), pa.array(np.full(len(vectors), d, np.int32)),
            as_lists(np.stack([unpack_symmetric(v[:square], d).ravel() for v in vectors])),
            as_lists(vectors[:, square:square + d]), pa.array(vectors[:, -2].copy()),
        ], ["n_rows", "n_cols", "ata", "atb", "btb"]

    return finish


def logistic_sums(model):
    """Chunk sums [n, loss, gradient] at one model."""

    def sums(a, y):
        sign = 1.0 - 2.0 * y
        loss, s = loss_and_sigmoid(sign * (a @ model))
        return np.concatenate([[float(len(y)), loss.sum()], a.T @ (sign * s)])

    return sums


def first_rows(pieces, n):
    """Takes ``n`` rows off the front of a list of matrices."""
    taken = []
    while n:
        part = pieces[0][:n]
        if len(part) < len(pieces[0]):
            pieces[0] = pieces[0][n:]
        else:
            del pieces[0]
        taken.append(part)
        n -= len(part)
    return taken


def rechunk(width, height, first_id, tail=0):
    """mapInArrow body: consecutive rows of a partition -> blocks of ``height`` rows.

    The last ``tail`` full blocks are held back and share the rest of the rows evenly with it, so that
    no block has below ``tail / (tail + 1)`` of the height, unless the partition holds less.
    ``first_id`` gives the id of this partition's first block; ids rise by one.
    """

    def emit(block_id, pieces, n):
        values = np.concatenate(pieces)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block_id], pa.int64()), pa.array([n], pa.int32()),
                pa.array([width], pa.int32()), as_lists(values.reshape(1, n * width)),
            ],
            ["block_id", "n_rows", "n_cols", "values"],
        )

    def run(batches):
        block_id, pieces, held = first_id(), [], 0
        for batch in batches:
            x = as_matrix(batch.column(0), width)
            if len(x):
                pieces.append(x)
                held += len(x)
            while held >= (tail + 1) * height:
                yield emit(block_id, first_rows(pieces, height), height)
                block_id, held = block_id + 1, held - height
        for left in range(-(-held // height), 0, -1):
            n = -(-held // left)
            yield emit(block_id, first_rows(pieces, n), n)
            block_id, held = block_id + 1, held - n

    return run


def rechunk_sorted(width, height):
    """mapInArrow body: rows sorted by (block_id, pos) -> one block per id.

    Fails as soon as an id holds more than ``height`` rows, so memory is bounded by one block.
    """

    def emit(block_id, pieces):
        values = np.concatenate(pieces)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block_id], pa.int64()), pa.array([len(values)], pa.int32()),
                pa.array([width], pa.int32()), as_lists(values.reshape(1, -1)),
            ],
            ["block_id", "n_rows", "n_cols", "values"],
        )

    def run(batches):
        current, pieces, held = None, [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = as_matrix(batch.column(1), width)
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for rows in np.split(np.arange(len(ids)), cuts):
                block_id = int(ids[rows[0]])
                if block_id != current:
                    if held:
                        yield emit(current, pieces)
                    current, pieces, held = block_id, [], 0
                held += len(rows)
                if held > height:
                    raise ValueError(f"block {block_id} has more than {height} rows: pos repeats")
                pieces.append(x[rows])
        if held:
            yield emit(current, pieces)

    return run


def block_matrices(values, n_rows, n_cols):
    """Yields the dense matrix of every block row of an Arrow batch, without copying."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    start = 0
    for n, d in zip(n_rows.to_pylist(), n_cols.to_pylist()):
        yield flat[start:start + n * d].reshape(n, d)
        start += n * d


def mirror_rows(model, c, block, pos):
    """Grouped function: rows of a block -> rows mixed with their mirror, labelled by ``model``."""
    d = len(model)

    def run(rows):
        place = rows[pos].to_numpy()
        order = np.argsort(place)
        n = len(order)
        if not np.array_equal(place[order], np.arange(n)):
            raise ValueError("the positions of a block are not 0 to n-1, each once")
        x = as_matrix(rows["features"].combine_chunks(), d)[order]
        label = np.where(x @ model < 0, -1.0, 1.0)
        half = n // 2
        mixed = x + c * x[::-1]
        mixed[half:] = x[half:] + c * mixed[::-1][half:]  # rows behind the middle
        if n % 2:
            mixed[half] = (1.0 + c) * x[half]
        mixed[-1] = x[-1]
        mixed[:, -2], mixed[:, -1] = x[:, -2], label
        return pa.Table.from_arrays(
            [rows[block].take(pa.array(order)), pa.array(np.arange(n)), as_lists(mixed),
             pa.array(label)], names=[block, pos, "features", "label"])

    return run


def fold_blocks():
    """Column function body: rows of blocks with a last -1/1 label -> -y * (features, 1)."""

    def run(values, n_rows, n_cols):
        pieces = []
        for block in block_matrices(values, n_rows, n_cols):
            y = block[:, -1:]
            if not np.isin(y, (-1.0, 1.0)).all():
                raise ValueError("a block has a label that is not -1 or 1")
            pieces.append((np.hstack([block[:, :-1], np.ones_like(y)]) * -y).ravel())
        offsets = np.cumsum([0, *(p.size for p in pieces)]).astype(np.int32)
        flat = np.concatenate(pieces) if pieces else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return run


def checked_start(value, grad):
    """Rows that are no numbers would pin a block to its start: they are an error."""
    if not (np.isfinite(value) and np.isfinite(grad).all()):
        raise ValueError("a block holds values that are not finite; run require_clean on the rows")


def at_precision(value, slope):
    """No step can gain more than the rounding of the value."""
    return -slope <= 1e-10 * max(1.0, abs(value))


def block_losses(models):
    """Partition function: blocks -> one vector, the summed loss of every model."""

    def run(batches):
        total = np.zeros(len(models))
        for batch in batches:
            for folded in block_matrices(*batch.columns):
                total += np.logaddexp(0.0, folded @ models.T).sum(axis=0)
        yield from one_partial(total)

    return run


def augmented_logistic(folded, w, center, rho):
    """Value, gradient and sigmoids of sum softplus(D w) + rho/2 |w - center|^2, D sign-folded."""
    loss, s = loss_and_sigmoid(folded @ w)
    shift = w - center
    return loss.sum() + 0.5 * rho * (shift @ shift), rho * shift + folded.T @ s, s


def newton_block(folded, start, center, rho, tol, max_iter=100):
    """Damped Newton on one block; the quadratic term makes every Hessian definite.

    Returns (w, steps, gradient norm, solved): solved is within ``tol``, or at the precision
    of the value.
    """
    w = start.copy()
    value, grad, s = augmented_logistic(folded, w, center, rho)
    checked_start(value, grad)
    for step in range(max_iter):
        size = float(np.linalg.norm(grad))
        if size <= tol:
            return w, step, size, True
        hessian = (folded * (s * (1.0 - s))[:, None]).T @ folded + rho * np.eye(len(w))
        direction = np.linalg.solve(hessian, -grad)
        slope, t = grad @ direction, 1.0
        while t > 1e-10:
            trial = w + t * direction
            trial_value, trial_grad, trial_s = augmented_logistic(folded, trial, center, rho)
            if trial_value <= value + 1e-4 * t * slope + 1e-12 * abs(value):
                break
            t *= 0.5
        else:
            return w, step, size, at_precision(value, slope)
        if np.linalg.norm(trial_grad) >= size and trial_value >= value:
            return w, step, size, at_precision(value, slope)
        w, value, grad, s = trial, trial_value, trial_grad, trial_s
    size = float(np.linalg.norm(grad))
    return w, max_iter, size, size <= tol or at_precision(value, slope)


def curvature_direction(grad, pairs):
    """Quasi-Newton direction -H grad from (step, gradient change) pairs, oldest first."""
    q, taken = grad.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (y @ s)
        q = q - a * y
        taken.append(a)
    if pairs:
        s, y = pairs[-1]
        q = q * ((s @ y) / (y @ y))
    for (s, y), a in zip(pairs, reversed(taken)):
        q = q + (a - (y @ q) / (y @ s)) * s
    return -q


def quasi_newton_block(folded, start, center, rho, tol, memory=7, max_iter=500):
    """Limited-memory quasi-Newton on one wide block; returns what ``newton_block`` does."""
    w, pairs = start.copy(), []
    value, grad, _ = augmented_logistic(folded, w, center, rho)
    checked_start(value, grad)
    for step in range(max_iter):
        size = float(np.linalg.norm(grad))
        if size <= tol:
            return w, step, size, True
        direction = curvature_direction(grad, pairs)
        slope, t = grad @ direction, 1.0 if pairs else 1.0 / size
        while t > 1e-12:
            trial = w + t * direction
            trial_value, trial_grad, _ = augmented_logistic(folded, trial, center, rho)
            if trial_value <= value + 1e-4 * t * slope + 1e-13 * abs(value):
                break
            t *= 0.5
        else:
            return w, step, size, at_precision(value, slope)
        s, y = trial - w, trial_grad - grad
        if s @ y > 1e-16 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        w, value, grad = trial, trial_value, trial_grad
    size = float(np.linalg.norm(grad))
    return w, max_iter, size, size <= tol or at_precision(value, slope)


def solve_logistic_blocks(z, rho, tol, memory, steps_at_most=None):
    """Column function body: x-update of every block in an Arrow batch."""
    d = len(z)
    limit = {} if steps_at_most is None else {"max_iter": steps_at_most}

    def run(values, n_rows, n_cols, u, x):
        duals, starts = as_matrix(u, d), as_matrix(x, d)
        models, steps, norms, solved = np.empty_like(starts), [], [], []
        for i, folded in enumerate(block_matrices(values, n_rows, n_cols)):
            center = z - duals[i]
            if d <= NEWTON_WIDTH:
                models[i], n, g, done = newton_block(folded, starts[i], center, rho, tol, **limit)
            else:
                models[i], n, g, done = quasi_newton_block(
                    folded, starts[i], center, rho, tol, memory, **limit)
            steps.append(n)
            norms.append(g)
            solved.append(done)
        return pa.StructArray.from_arrays(
            [as_lists(models), pa.array(steps, pa.int32()), pa.array(norms, pa.float64()),
             pa.array(solved, pa.bool_())],
            names=["x", "steps", "grad_norm", "solved"],
        )

    return run


def solve_grams(d, rho):
    """Column function body: (A'A + rho I)^-1 (A'b + rho v) for every row of an Arrow batch."""

    def run(ata, atb, v):
        left = as_matrix(ata, d * d).reshape(-1, d, d) + rho * np.eye(d)
        right = as_matrix(atb, d) + rho * as_matrix(v, d)
        if not (np.isfinite(left).all() and np.isfinite(right).all()):
            raise ValueError("a gram holds values that are not finite; check the rows")
        return as_lists(np.linalg.solve(left, right[:, :, None])[:, :, 0])

    return run


def eigen_grams(d):
    """Column function body: A'A -> its eigenvectors (row-major, one per column) and eigenvalues."""

    def run(ata):
        square = as_matrix(ata, d * d).reshape(-1, d, d)
        if not np.isfinite(square).all():
            raise ValueError("a gram holds values that are not finite; check the rows")
        if not len(square):
            return pa.StructArray.from_arrays(
                [pa.array([], DOUBLES), pa.array([], DOUBLES)], names=["vectors", "values"])
        values, vectors = np.linalg.eigh(square)
        return pa.StructArray.from_arrays(
            [as_lists(vectors.reshape(-1, d * d)), as_lists(values)], names=["vectors", "values"])

    return run


def solve_eigen(d, rho):
    """Column function body: (A'A + rho I)^-1 (A'b + rho v) from the kept factors: two products.

    Eigenvalues that rounding has made negative count as 0, as those of a gram are not below.
    """

    def run(vectors, values, atb, v):
        q = as_matrix(vectors, d * d).reshape(-1, d, d)
        right = as_matrix(atb, d) + rho * as_matrix(v, d)
        scaled = np.einsum("kij,ki->kj", q, right) / (np.maximum(as_matrix(values, d), 0.0) + rho)
        return as_lists(np.einsum("kij,kj->ki", q, scaled))

    return run


def multiply_blocks(matrix):
    """Column function body: block @ matrix, row-major."""

    def run(values, n_rows, n_cols):
        products = [b @ matrix for b in block_matrices(values, n_rows, n_cols)]
        offsets = np.cumsum([0, *(p.size for p in products)]).astype(np.int32)
        flat = np.concatenate([p.ravel() for p in products]) if products else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return run


def cut_bands(width, tile):
    """mapInArrow body: blocks -> bands of at most ``tile`` columns, one block at a time."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, block in zip(ids, block_matrices(*(batch.column(i) for i in (3, 1, 2)))):
                if block.shape[1] != width:
                    raise ValueError(f"a block of {block.shape[1]} columns, not {width}")
                for band, at in enumerate(range(0, width, tile)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([len(block)], pa.int32()),
                         pa.array([band], pa.int32()),
                         as_lists(block[:, at:at + tile].reshape(1, -1))],
                        ["block_id", "n_rows", "band", "values"])

    return run


def multiply_tiles(values, n_rows, height, tiles):
    """Column function: band of a block @ tile, row-major."""
    if tiles.null_count:
        raise ValueError("rows of the matrix are missing")
    shapes = zip(n_rows.to_pylist(), height.to_pylist())
    products = []
    for i, (n, h) in enumerate(shapes):
        left, right = values[i].values, tiles[i].values
        if left.null_count or right.null_count:
            raise ValueError("null matrix element")
        products.append(
            (left.to_numpy().reshape(n, h) @ right.to_numpy().reshape(h, -1)).ravel())
    offsets = np.cumsum([0, *map(len, products)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.concatenate(products) if products else np.empty(0)))


def gram_blocks(target_last):
    """Column function body: A'A, A'b, b'b of a block whose last column is b."""

    def run(values, n_rows, n_cols):
        atas, atbs, btbs = [], [], []
        for block in block_matrices(values, n_rows, n_cols):
            a, b = (block[:, :-1], block[:, -1]) if target_last else (block, np.zeros(len(block)))
            atas.append((a.T @ a).ravel())
            atbs.append(a.T @ b)
            btbs.append(float(b @ b))
        if not atas:
            return pa.StructArray.from_arrays(
                [pa.array([], DOUBLES), pa.array([], DOUBLES), pa.array([], pa.float64())],
                names=["ata", "atb", "btb"],
            )
        return pa.StructArray.from_arrays(
            [as_lists(np.stack(atas)), as_lists(np.stack(atbs)), pa.array(btbs, pa.float64())],
            names=["ata", "atb", "btb"],
        )

    return run
