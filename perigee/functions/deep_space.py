"""Lunar-solar and resonance terms for orbits of 225 minutes and more, on arrays.

Published equations (Hoots & Roehrich 1980; Vallado et al. 2006). Satellite
constants are computed once per satellite, then evaluated at its instants.
"""

from __future__ import annotations

from math import pi
from types import SimpleNamespace

import numpy as np

TWO_PI = 2 * pi
# fixed values: rates, eccentricities and strengths of the sun and the moon
SUN = SimpleNamespace(rate=1.19459e-5, ecc=0.01675, strength=2.9864797e-6)
MOON = SimpleNamespace(rate=1.5835218e-4, ecc=0.05490, strength=4.7968065e-7)
EARTH_RATE = 4.37526908801129966e-3
STEP = 720.0
SYNCHRONOUS, HALF_DAY = 1, 2
# fixed values: phases of the resonance terms
F2, F4, F6 = 0.13130908, 2.8843198, 0.37448087
G22, G32, G44, G52, G54 = 5.7686396, 0.95240898, 1.8014998, 1.0508330, 4.4108898


def _poly(e, *coefficients):
    return sum(c * e**power for power, c in enumerate(coefficients))


def _third_body(body, k, sin_g, cos_g, sin_i, cos_i, sin_h, cos_h):
    """Disturbance of one body: its orientation against the orbit's."""
    e2 = k.ecc**2
    beta2 = 1 - e2
    so, co = np.sin(k.argp), np.cos(k.argp)
    a1 = cos_g * cos_h + sin_g * cos_i * sin_h
    a3 = -sin_g * cos_h + cos_g * cos_i * sin_h
    a7 = -cos_g * sin_h + sin_g * cos_i * cos_h
    a9 = sin_g * sin_h + cos_g * cos_i * cos_h
    a8, a10 = sin_g * sin_i, cos_g * sin_i
    a2, a4 = k.cosi * a7 + k.sini * a8, k.cosi * a9 + k.sini * a10
    a5, a6 = -k.sini * a7 + k.cosi * a8, -k.sini * a9 + k.cosi * a10
    x1, x2 = a1 * co + a2 * so, a3 * co + a4 * so
    x3, x4 = -a1 * so + a2 * co, -a3 * so + a4 * co
    x5, x6, x7, x8 = a5 * so, a6 * so, a5 * co, a6 * co
    z31, z32, z33 = 12 * x1**2 - 3 * x3**2, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2**2 - 3 * x4**2
    z1 = 6 * (a1**2 + a2**2) + (2 * e2 + beta2) * z31
    z2 = 12 * (a1 * a3 + a2 * a4) + (2 * e2 + beta2) * z32
    z3 = 6 * (a3**2 + a4**2) + (2 * e2 + beta2) * z33
    z11 = -6 * a1 * a5 + e2 * (-24 * x1 * x7 - 6 * x3 * x5)
    z12 = -6 * (a1 * a6 + a3 * a5) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
    z13 = -6 * a3 * a6 + e2 * (-24 * x2 * x8 - 6 * x4 * x6)
    z21 = 6 * a2 * a5 + e2 * (24 * x1 * x5 - 6 * x3 * x7)
    z22 = 6 * (a4 * a5 + a2 * a6) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
    z23 = 6 * a4 * a6 + e2 * (24 * x2 * x6 - 6 * x4 * x8)
    s3 = body.strength / k.n
    s2 = -0.5 * s3 / np.sqrt(beta2)
    s4 = s3 * np.sqrt(beta2)
    s1 = -15 * k.ecc * s4
    # long-period amplitudes on the body's anomaly: (f2, f3, sin) for e, i, l, gh, h
    periodic = (
        (2 * s1 * (x2 * x3 + x1 * x4), 2 * s1 * (x2 * x4 - x1 * x3), 0.0),
        (2 * s2 * z12, 2 * s2 * (z13 - z11), 0.0),
        (-2 * s3 * z2, -2 * s3 * (z3 - z1), 2 * s3 * (21 + 9 * e2) * body.ecc),
        (2 * s4 * z32, 2 * s4 * (z33 - z31), -18 * s4 * body.ecc),
        (-2 * s2 * z22, -2 * s2 * (z23 - z21), 0.0),
    )
    # secular rates of e, i, m, gh, h
    secular = (
        s1 * body.rate * (x1 * x3 + x2 * x4),
        s2 * body.rate * (z11 + z13),
        -body.rate * s3 * (z1 + z3 - 14 - 6 * e2),
        s4 * body.rate * (z31 + z33 - 6),
        np.where(k.flat, 0.0, -body.rate * s2 * (z21 + z23)),
    )
    return periodic, secular


def constants(k: SimpleNamespace, epoch_days: np.ndarray, xke: float) -> None:
    """Append ``ds_*`` constants to the orbit constants; ``epoch_days`` count from
    1949-12-31 0h."""
    k.flat = (k.incl < 5.2359877e-2) | (k.incl > pi - 5.2359877e-2)
    day = epoch_days + 18261.5
    # orientation of the moon's orbit
    node = np.fmod(4.5236020 - 9.2422029e-4 * day, TWO_PI)
    sn, cn = np.sin(node), np.cos(node)
    cos_i = 0.91375164 - 0.03568096 * cn
    sin_i = np.sqrt(1 - cos_i**2)
    sin_h = 0.089683511 * sn / sin_i
    cos_h = np.sqrt(1 - sin_h**2)
    gamma = 5.8351514 + 0.0019443680 * day
    arg = gamma + np.arctan2(0.39785416 * sn / sin_i, cos_h * cn + 0.91744867 * sin_h * sn) - node
    so, co = np.sin(k.node), np.cos(k.node)
    sun = _third_body(SUN, k, -0.98088458, 0.1945905, 0.39785416, 0.91744867, so, co)
    moon = _third_body(
        MOON, k, np.sin(arg), np.cos(arg), sin_i, cos_i, so * cos_h - co * sin_h, cos_h * co + sin_h * so
    )
    k.ds_sun = np.fmod(6.2565837 + 0.017201977 * day, TWO_PI)
    k.ds_moon = np.fmod(4.7199672 + 0.22997150 * day - gamma, TWO_PI)
    for name, (periodic, _) in (("sun", sun), ("moon", moon)):
        for element, terms in zip(("e", "i", "l", "g", "h"), periodic, strict=True):
            for number, term in enumerate(terms):
                setattr(k, f"ds_{name}_{element}{number}", term + np.zeros_like(k.n))
    k.ds_edot, k.ds_idot, k.ds_mdot, gh, h = (a + b for a, b in zip(sun[1], moon[1], strict=True))
    turn = np.where(k.sini != 0, h / np.where(k.sini != 0, k.sini, 1.0), h)
    k.ds_argdot, k.ds_nodedot = gh - k.cosi * turn, turn
    # sidereal angle at epoch
    c = (epoch_days + 2433281.5 - 2451545.0) / 36525.0
    seconds = -6.2e-6 * c**3 + 0.093104 * c**2 + (876600.0 * 3600 + 8640184.812866) * c + 67310.54841
    k.ds_theta = np.mod(np.fmod(seconds * (pi / 180) / 240, TWO_PI), TWO_PI)
    _resonance(k, xke)


def _resonance(k: SimpleNamespace, xke: float) -> None:
    n, e, ci, si = k.n, k.ecc, k.cosi, k.sini
    e2 = e * e
    k.ds_kind = np.where(
        (n > 0.0034906585) & (n < 0.0052359877),
        SYNCHRONOUS,
        np.where((n >= 8.26e-3) & (n <= 9.24e-3) & (e >= 0.5), HALF_DAY, 0),
    )
    a = (n / xke) ** (2 / 3)  # one over the semi-major axis
    base = 3 * n**2 * a**2
    # synchronous: three terms
    f330 = 1.875 * (1 + ci) ** 3
    k.ds_s1 = base * (0.9375 * si**2 * (1 + 3 * ci) - 0.75 * (1 + ci)) * (1 + 2 * e2) * 2.1460748e-6 * a
    k.ds_s2 = 2 * base * 0.75 * (1 + ci) ** 2 * (1 + e2 * (-2.5 + 0.8125 * e2)) * 1.7891679e-6
    k.ds_s3 = 3 * base * f330 * (1 + e2 * (-6 + 6.60937 * e2)) * 2.2123015e-7 * a
    # half day: ten terms, eccentricity polynomials by range
    low, mid = e <= 0.65, e < 0.7
    g201 = -0.306 - (e - 0.64) * 0.440
    g211 = np.where(low, _poly(e, 3.616, -13.2470, 16.2900), _poly(e, -72.099, 331.819, -508.738, 266.724))
    g310 = np.where(low, _poly(e, -19.302, 117.3900, -228.4190, 156.5910), _poly(e, -346.844, 1582.851, -2415.925, 1246.113))
    g322 = np.where(low, _poly(e, -18.9068, 109.7927, -214.6334, 146.5816), _poly(e, -342.585, 1554.908, -2366.899, 1215.972))
    g410 = np.where(low, _poly(e, -41.122, 242.6940, -471.0940, 313.9530), _poly(e, -1052.797, 4758.686, -7193.992, 3651.957))
    g422 = np.where(low, _poly(e, -146.407, 841.8800, -1629.014, 1083.4350), _poly(e, -3581.690, 16178.110, -24462.770, 12422.520))
    g520 = np.where(
        low,
        _poly(e, -532.114, 3017.977, -5740.032, 3708.2760),
        np.where(e > 0.715, _poly(e, -5149.66, 29936.92, -54087.36, 31324.56), _poly(e, 1464.74, -4664.75, 3763.64)),
    )
    g533 = np.where(mid, _poly(e, -919.22770, 4988.6100, -9064.7700, 5542.21), _poly(e, -37995.780, 161616.52, -229838.20, 109377.94))
    g521 = np.where(mid, _poly(e, -822.71072, 4568.6173, -8491.4146, 5337.524), _poly(e, -51752.104, 218913.95, -309468.16, 146349.42))
    g532 = np.where(mid, _poly(e, -853.66600, 4690.2500, -8624.7700, 5341.4), _poly(e, -40023.880, 170470.89, -242699.48, 115605.82))
    c2, s2 = ci * ci, si * si
    f220 = 0.75 * (1 + 2 * ci + c2)
    f522 = 9.84375 * si * (s2 * (1 - 2 * ci - 5 * c2) + 0.33333333 * (-2 + 4 * ci + 6 * c2))
    f523 = si * (4.92187512 * s2 * (-2 - 4 * ci + 10 * c2) + 6.56250012 * (1 + 2 * ci - 3 * c2))
    f542 = 29.53125 * si * (2 - 8 * ci + c2 * (-12 + 8 * ci + 10 * c2))
    f543 = 29.53125 * si * (-2 - 8 * ci + c2 * (12 + 8 * ci - 10 * c2))
    k.ds_h0 = base * 1.7891679e-6 * f220 * g201
    k.ds_h1 = base * 1.7891679e-6 * 1.5 * s2 * g211
    k.ds_h2 = base * a * 3.7393792e-7 * 1.875 * si * (1 - 2 * ci - 3 * c2) * g310
    k.ds_h3 = base * a * 3.7393792e-7 * -1.875 * si * (1 + 2 * ci - 3 * c2) * g322
    k.ds_h4 = 2 * base * a**2 * 7.3636953e-9 * 35 * s2 * f220 * g410
    k.ds_h5 = 2 * base * a**2 * 7.3636953e-9 * 39.3750 * s2 * s2 * g422
    k.ds_h6 = base * a**3 * 1.1428639e-7 * f522 * g520
    k.ds_h7 = base * a**3 * 1.1428639e-7 * f523 * g532
    k.ds_h8 = 2 * base * a**3 * 2.1765803e-9 * f542 * g521
    k.ds_h9 = 2 * base * a**3 * 2.1765803e-9 * f543 * g533
    half = k.ds_kind == HALF_DAY
    k.ds_lon = np.fmod(
        np.where(half, k.m + 2 * k.node - 2 * k.ds_theta, k.m + k.node + k.argp - k.ds_theta), TWO_PI
    )
    k.ds_drift = (
        np.where(
            half,
            k.mdot + k.ds_mdot + 2 * (k.nodedot + k.ds_nodedot - EARTH_RATE),
            k.mdot + k.argpdot + k.nodedot - EARTH_RATE + k.ds_mdot + k.ds_argdot + k.ds_nodedot,
        )
        - k.n
    )


def _pull(k, lon, at):
    """Resonance acceleration of the mean motion and its derivative along longitude."""
    synchronous = k.ds_kind == SYNCHRONOUS
    p1, p2, p3 = lon - F2, 2 * (lon - F4), 3 * (lon - F6)
    w = k.argp + k.argpdot * at
    half = [
        (k.ds_h0, 1, 2 * w + lon - G22), (k.ds_h1, 1, lon - G22), (k.ds_h2, 1, w + lon - G32),
        (k.ds_h3, 1, -w + lon - G32), (k.ds_h4, 2, 2 * w + 2 * lon - G44), (k.ds_h5, 2, 2 * lon - G44),
        (k.ds_h6, 1, w + lon - G52), (k.ds_h7, 1, -w + lon - G52), (k.ds_h8, 2, w + 2 * lon - G54),
        (k.ds_h9, 2, -w + 2 * lon - G54),
    ]
    force = np.where(
        synchronous,
        k.ds_s1 * np.sin(p1) + k.ds_s2 * np.sin(p2) + k.ds_s3 * np.sin(p3),
        sum(d * np.sin(phase) for d, _, phase in half),
    )
    slope = np.where(
        synchronous,
        k.ds_s1 * np.cos(p1) + 2 * k.ds_s2 * np.cos(p2) + 3 * k.ds_s3 * np.cos(p3),
        sum(d * m * np.cos(phase) for d, m, phase in half),
    )
    return force, slope


def secular(k, t, n, e, incl, m, arg, node):
    """Deep-space secular terms added: (n, e, i, m, arg, node) at ``t``."""
    e, incl = e + k.ds_edot * t, incl + k.ds_idot * t
    arg, node, m = arg + k.ds_argdot * t, node + k.ds_nodedot * t, m + k.ds_mdot * t
    resonant = k.ds_kind > 0
    if np.any(resonant):
        # fixed steps from epoch towards t, the rest by a short expansion
        lon, rate = k.ds_lon, k.n
        steps = np.floor(np.abs(t) / STEP)
        delta = np.where(t < 0, -STEP, STEP)
        for number in range(int(steps[resonant].max()) + 1):
            at = number * delta
            force, slope = _pull(k, lon, at)
            moving = rate + k.ds_drift
            going = number < steps
            ahead = np.where(going, delta, t - at)
            done = number == steps
            n_here = rate + force * ahead + slope * moving * ahead**2 / 2
            l_here = lon + moving * ahead + force * ahead**2 / 2
            lon = np.where(going | done, l_here, lon)
            rate = np.where(going | done, n_here, rate)
        theta = np.fmod(k.ds_theta + t * EARTH_RATE, TWO_PI)
        half = k.ds_kind == HALF_DAY
        m = np.where(resonant, np.where(half, lon - 2 * node + 2 * theta, lon - node - arg + theta), m)
        n = np.where(resonant, rate, n)
    return n, e, incl, m, arg, node


def periodic(k, t, e, incl, m, arg, node):
    """Deep-space long-period terms: (e, i, m, arg, node)."""
    total = dict.fromkeys("eilgh", 0.0)
    for name, body in (("sun", SUN), ("moon", MOON)):
        zm = getattr(k, f"ds_{name}") + body.rate * t
        zf = zm + 2 * body.ecc * np.sin(zm)
        sin = np.sin(zf)
        f2, f3 = 0.5 * sin**2 - 0.25, -0.5 * sin * np.cos(zf)
        for x in total:
            a, b, c = (getattr(k, f"ds_{name}_{x}{i}") for i in range(3))
            total[x] = total[x] + a * f2 + b * f3 + c * sin
    pe, pi_, pl, pg, ph = (total[x] for x in "eilgh")
    incl, e = incl + pi_, e + pe
    si, ci = np.sin(incl), np.cos(incl)
    steep = incl >= 0.2
    turn = ph / np.where(steep, si, 1.0)
    # near the equator the node is ill-defined: rotate its direction instead
    so, co = np.sin(node), np.cos(node)
    wrapped = np.fmod(node, TWO_PI)
    moved = np.arctan2(
        si * so + ph * co + pi_ * ci * so, si * co - ph * so + pi_ * ci * co
    )
    longitude = m + arg + ci * wrapped + pl + pg - pi_ * wrapped * si
    gap = wrapped - moved
    moved = np.where(np.abs(gap) > pi, moved + np.where(moved < wrapped, TWO_PI, -TWO_PI), moved)
    m = m + pl
    arg = np.where(steep, arg + pg - ci * turn, longitude - m - ci * moved)
    node = np.where(steep, node + turn, moved)
    back = incl < 0
    return e, np.abs(incl), m, np.where(back, arg - pi, arg), np.where(back, node + pi, node)
