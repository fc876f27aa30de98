"""Places where blocks of small integers equal what follows them, by exact convolution in number-theoretic transforms.

For a block P and the text T that follows it, the sum of squared differences at distance d is
sum P^2 + sum T[d:]^2 - 2 * (P correlated with T)[d]. It is an integer, zero only where no word differs. It is taken modulo
as many primes as make their product larger than any such sum, so a sum that is zero modulo each is zero.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Primes below 2^31 with roots of unity of order 2^25, and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (2113929217, 5))
#: Integers that one round of transforms holds.
ROUND = 1 << 18


@lru_cache(maxsize=128)
def _powers(prime: int, generator: int, size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order `size`."""
    root = pow(generator, (prime - 1) // size, prime)
    root = pow(root, -1, prime) if inverse else root
    out = np.ones(max(size // 2, 1), U)
    n, step = 1, root
    while n < len(out):  # out[n:2n] = out[:n] * root^n
        out[n : 2 * n] = out[:n] * U(step) % U(prime)
        n, step = 2 * n, step * step % prime
    return out


def _less(x: np.ndarray, prime: int) -> np.ndarray:
    return np.minimum(x, x - U(prime))  # a negative difference wraps to a large number


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transforms of rows (a power of two long), their entries in bit-reversed order."""
    half = rows.shape[1] // 2
    while half:
        pair = rows.reshape(len(rows), -1, 2, half)
        first, second = pair[:, :, 0], pair[:, :, 1]
        out = np.empty_like(pair)
        out[:, :, 0] = _less(first + second, prime)
        out[:, :, 1] = (first + U(prime) - second) * _powers(prime, generator, 2 * half, False) % U(prime)
        rows, half = out.reshape(rows.shape), half // 2
    return rows


def inverse(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Undoes `transform`."""
    n, half = rows.shape[1], 1
    while half < n:
        pair = rows.reshape(len(rows), -1, 2, half)
        first, second = pair[:, :, 0], pair[:, :, 1] * _powers(prime, generator, 2 * half, True) % U(prime)
        out = np.empty_like(pair)
        out[:, :, 0] = _less(first + second, prime)
        out[:, :, 1] = _less(first + U(prime) - second, prime)
        rows, half = out.reshape(rows.shape), half * 2
    return rows * U(pow(n, -1, prime)) % U(prime)


def _mismatches(window: np.ndarray, size: int, prime: int, generator: int) -> np.ndarray:
    """Sums of squared differences modulo `prime`: a row for each block (its first `size` integers), a column for each distance
    0..size at which its own row goes on."""
    n = 2 * size
    window = window % U(prime)
    block = np.zeros_like(window)
    block[:, -np.arange(size) % n] = window[:, :size]  # reversed: the product of transforms is then a correlation
    product = transform(window, prime, generator) * transform(block, prime, generator) % U(prime)
    both = inverse(product, prime, generator)[:, : size + 1]
    squares = np.zeros((len(window), n + 1), U)
    np.cumsum(window * window % U(prime), axis=1, out=squares[:, 1:])
    own = (squares[:, size:] - squares[:, : size + 1]) % U(prime)
    return (own[:, :1] + own + U(2) * (U(prime) - both)) % U(prime)


def first_copies(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each block values[start : start + size] (size a power of two) the least distance in 1..size at which it stands again;
    0 if none. `values` goes on for 2 * size beyond each start."""
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    bound, product, primes = size * int(values.max()) ** 2, 1, []
    for p in PRIMES:
        if product <= bound:
            product *= p[0]
            primes.append(p)
    if product <= bound or 2 * size > 1 << 25:
        raise ValueError("a text of more than 2^25 distinct words or a block of more than 2^24")
    step = max(1, ROUND // (2 * size))
    for a in range(0, len(starts), step):
        here = starts[a : a + step]
        equal = np.ones((len(here), size), bool)
        window = values[here[:, None] + np.arange(2 * size)].astype(U)
        for p, g in primes:
            equal &= _mismatches(window, size, p, g)[:, 1:] == 0
        out[a : a + step] = np.where(equal.any(axis=1), equal.argmax(axis=1) + 1, 0)
    return out
