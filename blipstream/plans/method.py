"""Methods: ordered parameter sets, read from XML, compiled to one lazy plan."""

import math
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blipstream.operators import accumulate, baseline, events, kernels, rolling, search, thresholds, traces
from blipstream.operators.scan import TRACE

from .stored import stored


@dataclass(frozen=True)
class Step:
    kind: str
    params: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Method:
    steps: tuple[Step, ...]

    def run(self, points: DataFrame) -> DataFrame:
        """Events after all steps. A search starts anew; gates and filters need one before them."""
        found, location, sliced, slices, with_thr, model = None, None, None, None, None, {}
        for step in self.steps:
            p = step.params
            if step.kind == "time_roi":
                points = traces.time_roi(points, float(p["start"]), float(p["stop"]))
            elif step.kind == "rebin":
                points = traces.rebin(points, int(p["k"]))
            elif step.kind == "baseline":
                sliced = points.withColumn("slice_idx", F.lit(0))
                location = baseline.clipped(sliced, int(p.get("rounds", 5)), float(p.get("z", 3)), p.get("model") == "poisson").drop("slice_idx", "n_kept")
            elif step.kind == "search":
                found = find(points, location, float(p.get("offset", 0.5)), float(p.get("z", baseline.z_of(5e-7))))
            elif step.kind == "model":
                (sliced, slices), model = model_of(points, p), poisson_model(p)
            elif step.kind == "model_search" and slices is not None:
                found, with_thr = search_of(sliced, slices, p, model)
            elif step.kind == "model_gate" and with_thr is not None:
                found = gate_of(found, sliced, slices, with_thr, p, model)
            elif step.kind == "remove_channels" and found is not None:
                found = removed_of(found, points, p)
            elif step.kind == "gate" and found is not None:
                found = events.gate(found, p["test"], float(p["target"]))
            else:
                raise ValueError(f"no active search for, or no such step as, {step.kind!r}")
        return found if found is not None else points


def with_thresholds(points: DataFrame, location: DataFrame, offset: float, z: float) -> DataFrame:
    """Start and stop at the mean plus offset, height at mean + z * spread; one row per trace joins the points."""
    level = F.greatest(F.lit(baseline.PROTECTED), F.col("location"))
    joined = points.join(F.broadcast(location.select("sample_id", "channel", "location", "spread")), ["sample_id", "channel"])
    return joined.withColumn("start_thr", level + offset).withColumn("stop_thr", level + offset).withColumn("height_thr", F.greatest(F.lit(baseline.PROTECTED), F.col("location") + z * F.col("spread")))


def find(points: DataFrame, location: DataFrame, offset: float, z: float) -> DataFrame:
    return events.net_of_baseline(search.numbered(search.hysteresis_search(with_thresholds(search.rounded(points), location, offset, z))), location)


def read_method(xml: str) -> list[dict]:
    """SRC11: every parameter set of a method file as {name, parameters}; the order is the plan.

    Sets are the children of the method element, or of the root where there is none; a set's name is its attribute name or
    class, else its tag. Defaults kept beside a bundle of parameters don't count.
    """
    root = ET.fromstring(xml)
    at = root.find("method") if root.find("method") is not None else root

    def value(p: ET.Element) -> str:
        found = p.get("value")
        return found if found is not None else (p.text or "").strip()

    def parameters(of: ET.Element) -> dict[str, str]:
        defaults = {id(p) for d in of.iter("parameterBundleDefaults") for p in d.iter("parameter")}
        return {p.get("xmlID") or p.get("name") or str(i): value(p) for i, p in enumerate(of.iter("parameter")) if id(p) not in defaults}

    return [{"name": s.get("name") or s.get("class") or s.tag, "parameters": parameters(s)} for s in at]


#: The sets of a method file that are steps here, and what they become; sets of instruments, imports and reports aren't steps.
STEPS = {"TimeRoiParams": "time_roi", "BaselineParams": "model", "SearchParams": "model_search", "NormalSearchParams": "model_search", "GatingParams": "model_gate", "IsotopeRemoverParams": "remove_channels"}


def compile_method(xml: str) -> Method:
    """SRC11: the runnable method of a method file. Sets that are switched off, or of no kind in STEPS, are left out; a gate or filter before any search, or a search before any baseline, raises when it runs."""
    steps = []
    for s in read_method(xml):
        if s["name"] in STEPS and s["parameters"].get("enableBoolean", "true").lower() == "true":
            p = dict(s["parameters"])
            if STEPS[s["name"]] == "time_roi":
                p = {"start": p["startTime"], "stop": p["stopTime"]}
            steps.append(Step(STEPS[s["name"]], p))
    return Method(tuple(steps))


def truth(p: dict[str, str], key: str, default: bool = False) -> bool:
    return p.get(key, str(default)).lower() == "true"


#: Outlier procedures with their fixed numbers of clipping rounds; FIXED_NUMBER_ITERATION takes its own.
ROUNDS = {"NOTHING": 0, "ONE_ITERATION": 1}


def fit_of(points: DataFrame, kind: str, p: dict[str, str], whole: bool) -> DataFrame:
    """(slice, location, spread, distr) of one distribution by the set's outlier procedure."""
    poisson = kind == "POISSON"
    procedure = p.get("outlierTestTypePoisson" if poisson else "outlierTestTypeGauss", "FIXED_NUMBER_ITERATION")
    z = float(p.get("outlierFactorPoissonStart" if poisson else "outlierFactorGaussStart", 3))
    offset = float(p.get("outlierPoissonOffsetValue", 2.71)) if poisson and truth(p, "outlierPoissonOffsetBoolean", True) else 0.0
    if procedure in (*ROUNDS, "FIXED_NUMBER_ITERATION"):
        n = ROUNDS.get(procedure, int(p.get("outlierPoissonMaxNonSmartIncrements" if poisson else "outlierGaussMaxNonSmartIncrements", 5)))
        made = baseline.clipped(points, n, z, poisson, offset)
    elif procedure == "ITERATE_TO_CONVERGENCE":
        made = baseline.converged_rounds(points, z, offset, poisson) if whole or poisson else baseline.converged(points, z, offset)
    elif procedure == "SMART_INCREMENT_ITERATION" and not poisson:
        made = baseline.smart_clipped(points, z, float(p.get("outlierFactorMax", 10)), float(p.get("outlierFineIncrements", 0.1)), float(p.get("outlierDefaultMeanLowerCap", 0.1)), float(p.get("outlierStdDevByMeanSmallerThan", 1.5)))
    elif procedure == "ROSNER" and not poisson:
        made = kernels.rosner(points, float(p.get("outlierRosnerAlpha", 0.05)), float(p.get("outlierRosnerMaxPercent", 0.02)))
    else:
        raise ValueError(f"no outlier procedure {procedure!r} for {kind}")
    return made.select(*baseline.SLICE, "location", "spread").withColumn("distr", F.lit(kind))


def poisson_model(p: dict[str, str]) -> dict:
    """The Poisson model of a baseline set, as arguments of thresholds.critical_limit."""
    eps = float(p.get("poissonContinuityCorrection", 0.5)) if truth(p, "applyPoissonContinuityCorrection", True) else 0.0
    return {"poisson": p.get("poissonChoice", "POISSON"), "shape": float(p.get("siaShape", 0.47)), "eps": eps}


def model_of(points: DataFrame, p: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """points with slice_idx, and (slice, location, spread, distr), by a baseline set: constant or in segments, by the distribution that its approach selects."""
    whole = p.get("baselineDynamics", "CONSTANT") == "CONSTANT"
    if whole:
        sliced = points.withColumn("slice_idx", F.lit(0))
    else:
        dt = traces.dwell_times(points).agg(F.min("dt_s")).first()[0]
        if not dt:
            raise ValueError("segments need three points and a dwell time")
        sliced = traces.segment(points, max(1, round(float(p["baselineWidthPerSegment"]) / 1000 / dt)))
    sliced = stored(sliced, "sliced")
    approach = p.get("generalDistributionApproach", "PESSIMISTIC")
    if approach in ("GAUSSIAN_MODEL", "POISSON_MODEL"):
        return sliced, stored(fit_of(sliced, approach.removesuffix("_MODEL"), p, whole), "slices")
    both = stored(fit_of(sliced, "GAUSSIAN", p, whole).unionByName(fit_of(sliced, "POISSON", p, whole)), "slices")
    if approach == "THRESHOLD":
        cutoff = float(p.get("poissonNormalCutoff", 10))
        wanted = events.legacy_percentiles(sliced, baseline.SLICE, "intensity", {"__median": 0.5}).select(*baseline.SLICE, F.when(F.col("__median") < cutoff, "POISSON").otherwise("GAUSSIAN").alias("distr"))
        return sliced, stored(both.join(wanted, [*baseline.SLICE, "distr"]), "slices")
    if approach != "PESSIMISTIC":
        raise ValueError(f"no approach {approach!r}")
    limit = thresholds.critical_limit(both, 1.35e-3, name="__limit", **poisson_model(p))
    best = limit.groupBy(*baseline.SLICE).agg(F.max_by(F.struct("location", "spread", "distr"), F.struct("__limit", "distr")).alias("__m"))
    return sliced, stored(best.select(*baseline.SLICE, "__m.location", "__m.spread", "__m.distr"), "slices")


def criterion(p: dict[str, str], name: str) -> tuple[str, float]:
    how = p.get(name, "MEAN")
    keys = {"MEAN": None, "ALPHA": f"{name}AlphaValue", "FACTOR": f"{name}FactorValue", "CUSTOM_VALUE": f"{name}CustomValue"}
    return how, float(p[keys[how]]) if keys.get(how) else 0.0


def search_of(sliced: DataFrame, slices: DataFrame, p: dict[str, str], model: dict) -> tuple[DataFrame, DataFrame]:
    """(events, points with their thresholds) by a search set."""
    offset = float(p.get("startStopOffset", 0.5))
    for name, key, more in (("start_thr", "startCriterium", offset), ("stop_thr", "stopCriterium", offset), ("height_thr", "heightFilter", 0.0)):
        slices = thresholds.with_limit(slices, name, *criterion(p, key), more, **model)
    points = thresholds.onto_points(sliced, slices, ["location", "spread", "start_thr", "stop_thr", "height_thr"])
    points = stored(points.join(slices.select(*baseline.SLICE, "distr"), baseline.SLICE), "with-thresholds")
    how = p.get("searchAlgorithm", "SPLIT_CORRECTION")
    seen = search.rounded(points)
    if how == "SIMPLE":
        one = search.simple_search(seen)
        found = search.peaks(one.select(*TRACE, "start_idx", "end_idx"), points).drop("peak_thr")
    elif how == "SPLIT_CORRECTION":
        found = search.hysteresis_search(seen)
    elif how == "SPLIT_CORRECTION_WINDOW":
        dt = traces.dwell_times(points).agg(F.min("dt_s")).first()[0]
        found = search.window_search(seen, round(float(p["windowWidth"]) * 1e-6 / dt), float(p["windowBonusWidth"]) * 1e-6 / dt)
    elif how == "SPLIT_CORRECTION_SMOOTH":
        dt = traces.dwell_times(points).agg(F.min("dt_s")).first()[0]
        found = search.smooth_merge_search(points, math.ceil(float(p["smoothGaussianWidth"]) * 1e-6 / dt), p.get("rawSmoothType", "MOAV"))
    elif how == "P_VALUE_ACCUMULATION":
        single = float(p["singleComponentPValueThresholdAlphaValue"]) if truth(p, "enableSingleComponentPValueThreshold") else None
        found = accumulate.accumulated_search(thresholds.model_p(points, model["poisson"], model["shape"]), float(p["pValueStartStopAlphaValue"]), float(p["pValueThresholdAlphaValue"]), single, p.get("pStatistics", "CHI_SQUARE"), points)
    else:
        raise ValueError(f"no search {how!r}")
    found = stored(search.numbered(found.select(*TRACE, "start_idx", "end_idx", "peak_idx", "n_points", "area", "height")), "found")
    net, clamp = p.get("netCorrectionOption", "BLN_MEAN"), truth(p, "suppressNegativeValues")
    if net == "BLN_MEAN":
        of_peak = thresholds.at_peaks(found, points, ["location"])
        bg = F.greatest(F.lit(baseline.PROTECTED), F.col("location")) * F.col("n_points")
        out = of_peak.withColumn("bg_per_event", F.least(bg, F.col("area")) if clamp else bg).drop("location")
        out = out.withColumn("net_area", F.col("area") - F.col("bg_per_event")).withColumn("net_height", F.greatest(F.lit(0.0), F.col("height")) - F.col("bg_per_event") / F.col("n_points"))
    else:
        half = float(p.get("netTimeWindow", 0.5))
        by = "INDEX" if net == "INDEX_APPROXIMATION" else "TIME"
        if by == "INDEX":
            half = math.ceil(half / traces.dwell_times(points).agg(F.min("dt_s")).first()[0])
        out = rolling.background_of_events(found, points, half, by, p.get("netTimeWindowLocation", "MEAN"), clamp).drop("n_bg", "bg_mean", "bg_median")
    return out, points


#: Gates by what a limit is compared with; of these heights and means see the limit itself, areas too, the others a plain number.
LIMITED = ("HEIGHT", "AREA", "NET_AREA", "MEAN_SIGNAL")


def gate_of(found: DataFrame, sliced: DataFrame, slices: DataFrame, points: DataFrame, p: dict[str, str], model: dict) -> DataFrame:
    """Events that pass a gating set. Limits are those of the background at the event's peak, not protected from below."""
    kind = p["gatingOption"]
    if kind == "ACCUMULATED_P":
        return thresholds.accumulated_gate(found, points, float(p["pValueAccumulationAlpha"]), poisson=model["poisson"], shape=model["shape"])
    if kind in LIMITED:
        how, key = {"ALPHA": ("ALPHA", "alphaValue"), "Z_VALUE": ("FACTOR", "zValue"), "CUSTOM_VALUE": ("CUSTOM_VALUE", "absoluteCutoff")}[p.get("measureOfSignificance", "ALPHA")]
        limited = thresholds.with_limit(slices, "__gate", how, float(p[key]), protected=False, **model)
        target = thresholds.at_peaks(found, thresholds.onto_points(sliced, limited, ["__gate"]), ["__gate"])
        by = float(p.get("factor", 1)) if truth(p, "factorBoolean") else 1.0
        target = target.withColumn("__gate", F.col("__gate") * by)
    else:
        target = found.withColumn("__gate", F.lit(float(p["spikeBalancePercent" if kind == "PEAK_DOMINANCE" else "absoluteCutoff"])))
    return thresholds.gate_at_peak(target, kind, "__gate").select(*found.columns)


def removed_of(found: DataFrame, points: DataFrame, p: dict[str, str]) -> DataFrame:
    seconds = traces.dwell_times(points).select(*TRACE, F.col("duration_s").alias("seconds"))
    given = {a: float(p[v]) for a, on, v in (("most_rate", "removeMoreIsotopesThan", "moreIsotopesRate"), ("least_count", "removeFewerIsotopesThan", "fewerIsotopesNumber"), ("least_net", "removeLessIntenseIsotopesThan", "netAreaThreshold")) if truth(p, on)}
    return events.remove_channels(found, seconds, **given)


def settings(method: Method) -> list[tuple[int, str, str, str]]:
    """SNK9: (step, kind, parameter, value)."""
    return [(i, s.kind, k, v) for i, s in enumerate(method.steps) for k, v in s.params.items()]
