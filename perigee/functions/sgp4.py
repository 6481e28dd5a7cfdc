"""SGP4 on Arrow batches (Hoots & Roehrich 1980; Vallado et al. 2006).

The only Python work in the engine. Spark places satellites and instants, a task
receives flat batches, and each batch is a few hundred vector operations. As
native columns the same chain plans for many seconds (a filter on its result is
inlined through every step), so it stays behind ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from perigee.functions import deep_space
from perigee.fixed_values import SGP4_J2, SGP4_J3, SGP4_J4, SGP4_MU, SGP4_RADIUS_KM

TWO_PI = 2 * pi
XKE = 60.0 / (SGP4_RADIUS_KM**3 / SGP4_MU) ** 0.5
J2, J4 = SGP4_J2, SGP4_J4
J3_OVER_J2 = SGP4_J3 / SGP4_J2
KM_PER_SECOND = SGP4_RADIUS_KM * XKE / 60.0
DEEP_SPACE_MINUTES = 225.0
KEPLER_PASSES = 10

# fixed value: status texts
OK = "ok"
BAD_PERTURBED = "perturbed eccentricity is outside the range 0.0 to 1.0"
BAD_ECCENTRICITY = "mean eccentricity is outside the range 0.0 to 1.0"
BAD_MEAN_MOTION = "mean motion has fallen below zero"
BAD_SEMILATUS = "semilatus rectum has fallen below zero"
DECAYED = "mrt is less than 1.0 which indicates the satellite has decayed"
STATUSES = np.array([OK, BAD_ECCENTRICITY, BAD_MEAN_MOTION, BAD_PERTURBED, BAD_SEMILATUS, DECAYED])

ELEMENTS = [
    "mean_motion", "inclination", "eccentricity", "ra_of_asc_node", "arg_of_pericenter", "mean_anomaly", "bstar",
    "epoch_days",
]
AXES = ["x_km", "y_km", "z_km", "vx_km_s", "vy_km_s", "vz_km_s"]


def orbit_constants(el: np.ndarray) -> SimpleNamespace:
    """What depends on the satellite alone; ``el`` is one row per element in
    ``ELEMENTS`` order, radians and minutes, epoch in days from 1949-12-31."""
    n_kozai, incl, ecc, node, argp, m, bstar, epoch_days = el
    k = SimpleNamespace(incl=incl, ecc=ecc, node=node, argp=argp, m=m)
    k.cosi, k.sini = np.cos(incl), np.sin(incl)
    cos2 = k.cosi**2
    cos4 = cos2 * cos2
    k.con41, k.x1mth2, k.x7thm1 = 3 * cos2 - 1, 1 - cos2, 7 * cos2 - 1
    omeo = 1 - ecc**2
    rteo = np.sqrt(omeo)
    # mean motion without the Kozai correction
    ak = (XKE / n_kozai) ** (2 / 3)
    d1 = 0.75 * J2 * k.con41 / (rteo * omeo)
    d = d1 / ak**2
    a0 = ak * (1 - d * d - d * (1 / 3 + 134 * d * d / 81))
    k.n = n_kozai / (1 + d1 / a0**2)
    a = (XKE / k.n) ** (2 / 3)
    # drag: the density profile starts lower for low perigees
    perigee = (a * (1 - ecc) - 1) * SGP4_RADIUS_KM
    s_km = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
    s = s_km / SGP4_RADIUS_KM + 1
    q4 = ((120 - s_km) / SGP4_RADIUS_KM) ** 4
    tsi = 1 / (a - s)
    k.eta = a * ecc * tsi
    eta2, ee = k.eta**2, ecc * k.eta
    psi2 = np.abs(1 - eta2)
    coef = q4 * tsi**4
    coef1 = coef / psi2**3.5
    cc2 = coef1 * k.n * (
        a * (1 + 1.5 * eta2 + ee * (4 + eta2))
        + 0.375 * J2 * tsi / psi2 * k.con41 * (8 + 3 * eta2 * (8 + eta2))
    )
    k.cc1 = bstar * cc2
    eccentric = ecc > 1e-4
    cc3 = np.where(eccentric, -2 * coef * tsi * J3_OVER_J2 * k.n * k.sini / ecc, 0.0)
    shape = -3 * k.con41 * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * k.x1mth2 * (
        2 * eta2 - ee * (1 + eta2)
    ) * np.cos(2 * argp)
    k.bcc4 = bstar * 2 * k.n * coef1 * a * omeo * (
        k.eta * (2 + 0.5 * eta2) + ecc * (0.5 + 2 * eta2) - J2 * tsi / (a * psi2) * shape
    )
    k.bcc5 = bstar * 2 * coef1 * a * omeo * (1 + 2.75 * (eta2 + ee) + ee * eta2)
    # secular rates
    pinv2 = 1 / (a * omeo) ** 2
    t1 = 1.5 * J2 * pinv2 * k.n
    t2 = 0.5 * t1 * J2 * pinv2
    t3 = -0.46875 * J4 * pinv2**2 * k.n
    k.mdot = k.n + 0.5 * t1 * rteo * k.con41 + 0.0625 * t2 * rteo * (13 - 78 * cos2 + 137 * cos4)
    k.argpdot = (
        -0.5 * t1 * (1 - 5 * cos2) + 0.0625 * t2 * (7 - 114 * cos2 + 395 * cos4) + t3 * (3 - 36 * cos2 + 49 * cos4)
    )
    node1 = -t1 * k.cosi
    k.nodedot = node1 + (0.5 * t2 * (4 - 19 * cos2) + 2 * t3 * (3 - 7 * cos2)) * k.cosi
    k.nodecf = 3.5 * omeo * node1 * k.cc1
    k.omg = bstar * cc3 * np.cos(argp)
    k.xm = np.where(eccentric, -2 / 3 * coef * bstar / ee, 0.0)
    k.t2 = 1.5 * k.cc1
    k.delmo, k.sinmo = (1 + k.eta * np.cos(m)) ** 3, np.sin(m)
    # higher drag terms, left out for low perigees
    k.deep = k.n <= TWO_PI / DEEP_SPACE_MINUTES
    k.full = (perigee >= 220) & ~k.deep
    c1sq = k.cc1**2
    k.d2 = 4 * a * tsi * c1sq
    third = k.d2 * tsi * k.cc1 / 3
    k.d3 = (17 * a + s) * third
    k.d4 = 0.5 * third * a * tsi * (221 * a + 31 * s) * k.cc1
    k.t3 = k.d2 + 2 * c1sq
    k.t4 = 0.25 * (3 * k.d3 + k.cc1 * (12 * k.d2 + 10 * c1sq))
    k.t5 = 0.2 * (3 * k.d4 + 12 * k.cc1 * k.d3 + 6 * k.d2**2 + 15 * c1sq * (2 * k.d2 + c1sq))
    if np.any(k.deep):
        deep_space.constants(k, epoch_days, XKE)
    return k


def _deep(fn, k: SimpleNamespace, t: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Apply a deep-space step to the rows that need it."""
    rows = np.flatnonzero(k.deep)
    part = SimpleNamespace(**{name: v[rows] for name, v in vars(k).items()})
    results = fn(part, t[rows], *[v[rows] for v in values])
    out = [v.copy() for v in values]
    for target, result in zip(out, results, strict=True):
        target[rows] = result
    return out


def propagate(k: SimpleNamespace, t: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Status index and the six TEME axes at ``t`` minutes from epoch."""
    # secular gravity and drag
    m = k.m + k.mdot * t
    arg = k.argp + k.argpdot * t
    node = k.node + k.nodedot * t + k.nodecf * t * t
    shift = np.where(k.full, k.omg * t + k.xm * ((1 + k.eta * np.cos(m)) ** 3 - k.delmo), 0.0)
    m, arg = m + shift, arg - shift
    ta = 1 - k.cc1 * t - np.where(k.full, t * t * (k.d2 + t * (k.d3 + t * k.d4)), 0.0)
    te = k.bcc4 * t + np.where(k.full, k.bcc5 * (np.sin(m) - k.sinmo), 0.0)
    tl = k.t2 * t * t + np.where(k.full, t**3 * (k.t3 + t * (k.t4 + t * k.t5)), 0.0)
    n, e0, incl = k.n, k.ecc, k.incl
    any_deep = np.any(k.deep)
    if any_deep:
        n, e0, incl, m, arg, node = _deep(deep_space.secular, k, t, n, e0, incl, m, arg, node)
    n0 = n
    a = (XKE / n) ** (2 / 3) * ta * ta
    n = XKE / a**1.5
    e0 = e0 - te
    e = np.maximum(e0, 1e-6)
    lon = np.fmod(m + k.n * tl + arg + node, TWO_PI)
    node, arg = np.fmod(node, TWO_PI), np.fmod(arg, TWO_PI)
    m = np.fmod(lon - arg - node, TWO_PI)
    ep, sini, cosi = e, k.sini, k.cosi
    con41, x1mth2, x7thm1 = k.con41, k.x1mth2, k.x7thm1
    if any_deep:
        ep, incl, m, arg, node = _deep(deep_space.periodic, k, t, e, incl, m, arg, node)
        sini, cosi = np.sin(incl), np.cos(incl)
        con41, x1mth2, x7thm1 = 3 * cosi**2 - 1, 1 - cosi**2, 7 * cosi**2 - 1
    # long-period terms
    ax = ep * np.cos(arg)
    p = 1 / (a * (1 - ep * ep))
    ay = ep * np.sin(arg) - p * 0.5 * J3_OVER_J2 * sini
    polar = np.where(np.abs(cosi + 1) > 1.5e-12, 1 + cosi, 1.5e-12)
    u = np.fmod(m + arg - p * 0.25 * J3_OVER_J2 * sini * (3 + 5 * cosi) / polar * ax, TWO_PI)
    # Kepler's equation, steps limited as published
    eo = u
    for _ in range(KEPLER_PASSES):
        sin, cos = np.sin(eo), np.cos(eo)
        step = (u - ay * cos + ax * sin - eo) / (1 - cos * ax - sin * ay)
        eo = eo + np.clip(step, -0.95, 0.95)
        if not np.any(np.abs(step) >= 1e-12):
            break
    esine = ax * sin - ay * cos
    el2 = ax * ax + ay * ay
    pl = a * (1 - el2)
    rl = a * (1 - ax * cos - ay * sin)
    beta = np.sqrt(1 - el2)
    share = esine / (1 + beta)
    sinu, cosu = a / rl * (sin - ay - ax * share), a / rl * (cos - ax + ay * share)
    sin2u, cos2u = 2 * cosu * sinu, 1 - 2 * sinu**2
    # short-period terms
    t1 = 0.5 * J2 / pl
    t2 = t1 / pl
    r = rl * (1 - 1.5 * t2 * beta * con41) + 0.5 * t1 * x1mth2 * cos2u
    su = np.arctan2(sinu, cosu) - 0.25 * t2 * x7thm1 * sin2u
    node = node + 1.5 * t2 * cosi * sin2u
    incl = incl + 1.5 * t2 * cosi * sini * cos2u
    rate = np.sqrt(a) * esine / rl - n * t1 * x1mth2 * sin2u / XKE
    across = np.sqrt(pl) / rl + n * t1 * (x1mth2 * cos2u + 1.5 * con41) / XKE
    ssu, csu, sn, cn, si, ci = (f(v) for v in (su, node, incl) for f in (np.sin, np.cos))
    ux, uy, uz = cn * csu - sn * ci * ssu, sn * csu + cn * ci * ssu, si * ssu
    vx, vy, vz = -cn * ssu - sn * ci * csu, cn * ci * csu - sn * ssu, si * csu
    position = [r * w * SGP4_RADIUS_KM for w in (ux, uy, uz)]
    velocity = [(rate * w + across * v) * KM_PER_SECOND for w, v in ((ux, vx), (uy, vy), (uz, vz))]
    status = np.select(
        [k.ecc >= 1, ~(n0 > 0), ~((e0 < 1) & (e0 >= -0.001)), ~((ep >= 0) & (ep <= 1)), pl < 0, ~(r >= 1)],
        [1, 2, 1, 3, 4, 5],
        default=0,
    )
    return status, position + velocity


def state_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the ``el_*`` and ``minutes`` columns of each batch by axes and status.

    Rows of one satellite arrive together, so constants are computed once per run
    of equal elements and repeated over its instants.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        el = np.vstack([batch.column(f"el_{e}").to_numpy(zero_copy_only=False) for e in ELEMENTS])
        starts = np.flatnonzero(np.r_[True, np.any(el[:, 1:] != el[:, :-1], axis=0)])
        lengths = np.diff(np.r_[starts, batch.num_rows])
        with np.errstate(all="ignore"):
            once = orbit_constants(el[:, starts])
            k = SimpleNamespace(**{name: np.repeat(v, lengths) for name, v in vars(once).items()})
            status, axes = propagate(k, batch.column("minutes").to_numpy(zero_copy_only=False))
        names = [n for n in batch.schema.names if not n.startswith("el_") and n != "minutes"]
        columns = [batch.column(n) for n in names]
        failed = status != 0
        columns += [pa.array(axis, mask=failed) for axis in axes]
        columns.append(pa.array(STATUSES[status]))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, *AXES, "status"])
