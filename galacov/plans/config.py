"""One run's settings, with the rules of which go together."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from galacov.operators.pairs import Bins

S_MU, PROJECTED, ACCUMULATED = "s_mu", "legendre_projected", "legendre_accumulated"


@dataclass(frozen=True)
class RunConfig:
    mode: str = S_MU
    bins: Bins = field(default_factory=lambda: Bins(tuple((20.0 + 4 * i, 24.0 + 4 * i) for i in range(45)), n_mu=1))
    max_l: int | None = None
    boxsize: float = 0.0
    jackknife: bool = False
    tracers: int = 1
    xi_cut: float = 250.0
    n2: int = 5
    n3: int = 10
    n4: int = 20
    loops: int = 1024
    loops_per_sample: int = 64
    nside: int = 301
    seed: int = 0
    cf_loops: int = 10
    norms: tuple[float, ...] = (1.0,)
    skip_r_bins: tuple[int, int] = (0, 0)
    skip_l: int = 0
    alphas: tuple[float, ...] = (1.0,)
    rescale: float = 1.0
    mocks: bool = False

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.mode in (S_MU, PROJECTED, ACCUMULATED), f"mode {self.mode}")
        need(self.tracers in (1, 2), "one or two tracers")
        need(len(self.norms) == self.tracers, "a norm for each tracer")
        need(len(self.alphas) == self.tracers, "a rescaling for each tracer")
        if self.mode == S_MU:
            need(self.max_l is None, "multipoles only in a Legendre mode")
        else:
            need(self.max_l is not None and self.max_l % 2 == 0 and self.max_l >= 0, "a Legendre mode needs an even max_l")
        if self.mode == ACCUMULATED:
            need(not self.jackknife, "no jackknife with accumulated Legendre moments")
            need(self.max_l <= 10, "max_l is at most 10")
        need(self.boxsize >= 0, "a box side of 0 or more")
        need(self.loops % self.loops_per_sample == 0, "loops in whole subsamples")
        need(min(self.n2, self.n3, self.n4, self.loops, self.loops_per_sample) > 0, "draws and loops above 0")
        need(self.xi_cut > 0, "a cutoff above 0")
        need(sum(self.skip_r_bins) < len(self.bins.edges), "some radial bins stay")

    @property
    def periodic(self) -> bool:
        return self.boxsize > 0

    @property
    def n_bins(self) -> int:
        return len(self.bins.edges) * (self.bins.n_mu if self.mode == S_MU else self.max_l // 2 + 1)

    def quads(self, n_randoms: tuple[int, ...]) -> int:
        """Attempted quads of a run: what its time is proportional to."""
        draws = self.n2 * self.n3 * self.n4 * self.loops
        return draws * (n_randoms[0] if self.tracers == 1 else 5 * n_randoms[0] + 2 * n_randoms[1])


def replaced(c: RunConfig, edges: tuple[tuple[float, float], ...]) -> RunConfig:
    """The same settings over other radial bins."""
    return replace(c, bins=Bins(edges, c.bins.n_mu, c.bins.mu_low, c.bins.mu_high))


def parse(args: list[str]) -> RunConfig:
    """From words like -n2 5 -boxsize 1000 -mode s_mu; -bins low high n makes linear bins."""
    kinds = {f.name: f for f in fields(RunConfig)}
    given, at = {}, 0
    while at < len(args):
        name = args[at].lstrip("-")
        if name == "bins":
            low, high, n = float(args[at + 1]), float(args[at + 2]), int(args[at + 3])
            given["bins"] = Bins(tuple((low + (high - low) / n * i, low + (high - low) / n * (i + 1)) for i in range(n)), given["bins"].n_mu if "bins" in given else 1)
            at += 4
            continue
        if name == "mbin":
            b = given.get("bins", RunConfig().bins)
            given["bins"] = Bins(b.edges, int(args[at + 1]))
            at += 2
            continue
        if name not in kinds:
            raise ValueError(f"no such setting: {args[at]}")
        default = getattr(RunConfig, name, None)
        if isinstance(default, bool):
            given[name], at = True, at + 1
            continue
        text = args[at + 1]
        if isinstance(default, tuple):
            given[name] = tuple(type(default[0])(x) for x in text.split(","))
        else:
            given[name] = text if name == "mode" else int(text) if name == "max_l" or isinstance(default, int) else float(text)
        at += 2
    return RunConfig(**given)
