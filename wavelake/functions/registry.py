"""Registry documents: a walk over nested documents, identifier scans of their strings, and submissions built from allowed fields only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.functions.text import nfkc, submission_findings
from wavelake.operators.cohort import bucket
from wavelake.session import saved

#: Paths whose strings come from closed vocabularies or are identifiers of a checked form; they are not scanned.
SKIPPED_PATHS = ("$.submission_id", "$.intervention.linked_pre_submission_id", "$.findings.coupling_plv_bucket", "$.findings.coupling_preferred_phase_octant", "$.findings.coupling_n_events_bucket",
                 "$.findings.sw_density_bucket", "$.findings.sw_mean_ptp_bucket", "$.findings.sw_method", "$.findings.hfo_rate_bucket", "$.findings.hfo_pct_on_spike_bucket", "$.findings.ied_method",
                 "$.findings.ied_rate_bucket", "$.findings.ied_age_flag", "$.findings.ied_agreement_bucket", "$.findings.ied_n_rolandic_benign_bucket", "$.findings.ied_nrem_rate_bucket")


def walk(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """keys, path, kind, text: a row for every leaf of a JSON document (a string column, or a variant), however deep.

    Paths are as $.a.b[0]; kind is the leaf's type in upper case, text its value as a string (null for a JSON null). An empty object or array has no leaf; a text that
    is no JSON is one leaf of kind INVALID, a null document none. Each level is one step over the containers of the level before."""
    keys = list(keys)
    own = F.col(document) if df.schema[document].dataType.typeName() == "variant" else F.try_parse_json(document)
    rows = df.where(F.col(document).isNotNull()).select(*keys, F.lit("$").alias("path"), own.alias("v"), F.col(document).cast("string").alias("raw"))
    bad = rows.where("v is null").select(*keys, "path", F.lit("INVALID").alias("kind"), F.col("raw").alias("text"))
    level, out = rows.where("v is not null").select(*keys, "path", "v"), [bad]
    while True:
        level = saved(level.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)), "walk")
        out.append(level.where("kind not in ('OBJECT', 'ARRAY')").select(*keys, "path", "kind", F.try_variant_get("v", "$", "string").alias("text")))
        held = level.where("kind in ('OBJECT', 'ARRAY')")
        if held.isEmpty():
            break
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        level = held.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("part"))).select(
            *keys, F.concat("path", step).alias("path"), F.col("part").alias("v"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def scan_documents(df: DataFrame, keys: Sequence[str], document: str, skipped: Sequence[str] = SKIPPED_PATHS, fold: bool = True) -> DataFrame:
    """keys, path, findings: the strings of documents that hold what none may, and what that is (array); see ``submission_findings``.

    Strings at the ``skipped`` paths are not looked at, numbers and flags never. With ``fold`` patterns are sought in the text after NFKC."""
    leaves = walk(df, keys, document).where("kind in ('STRING', 'INVALID')").where(~F.col("path").isin(*skipped) if skipped else F.lit(True))
    folded = nfkc(F.col("text")) if fold else F.col("text")
    found = leaves.withColumn("_folded", folded).withColumn("findings", submission_findings(F.col("text"), F.col("_folded")))
    return found.where(F.size("findings") > 0).select(*keys, "path", "findings")


class Field:
    """One allowed field: where it is in a findings document, and what of it may leave."""

    def __init__(self, path: str):
        self.at = lambda v: F.try_variant_get(v, f"$.{path}", "variant")

    def _kind(self, v: Column) -> Column:
        return F.schema_of_variant(self.at(v))

    def number(self, v: Column, whole: bool = False) -> Column:
        """A finite number, not a text or flag that could be read as one."""
        kinds = "^(TINYINT|SMALLINT|INT|BIGINT)$" if whole else "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
        x = F.try_variant_get(self.at(v), "$", "double")
        return F.when(self._kind(v).rlike(kinds) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)

    def text(self, v: Column) -> Column:
        return F.when(self._kind(v) == "STRING", F.try_variant_get(self.at(v), "$", "string"))

    def flag(self, v: Column) -> Column:
        return F.when(self._kind(v) == "BOOLEAN", F.try_variant_get(self.at(v), "$", "boolean"))


def within(path: str, low: float, high: float, open_end: bool = False):
    def make(v):
        x = Field(path).number(v)
        return F.when((x >= low) & ((x < high) if open_end else (x <= high)), x)
    return make


def word(path: str, *allowed: str):
    return lambda v: F.when(Field(path).text(v).isin(*allowed), Field(path).text(v))


def flag(path: str):
    return lambda v: Field(path).flag(v)


def band(path: str, edges: Sequence[float], labels: Sequence[str], zero: str | None = None, whole: bool = False, most: float | None = None):
    """The label of a number's half-open band; none for negative numbers or those over ``most``."""
    def make(v):
        x = Field(path).number(v, whole)
        return F.when((x >= 0) & (F.lit(True) if most is None else x <= most), bucket(x, edges, labels, zero))
    return make


def stages(*paths: str):
    """Percentages by sleep stage, of the first of the paths that is an object; null without any."""
    names = ("WAKE", "N1", "N2", "N3", "REM")

    def make(v):
        first = F.lit(None)
        for path in reversed(paths):
            each = F.struct(*[within(f"{path}.{n}", 0, 100)(v).alias(n) for n in names])
            first = F.when(Field(path)._kind(v).startswith("OBJECT") & (Field(path)._kind(v) != "OBJECT<>"), each).otherwise(first)
        return F.when(F.coalesce(*[first[n] for n in names]).isNotNull(), first)
    return make


def octant(path: str):
    """The eighth of a circle that a phase in degrees lies in, the last closed at 180."""
    def make(v):
        x = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), Field(path).number(v)))
        low = F.least(F.floor(x / 45) * 45, F.lit(135))
        return F.when(Field(path).number(v).isNotNull(), F.concat(F.lit("["), low, F.lit(","), low + 45, F.when(low == 135, "]").otherwise(")")))
    return make


def pair(path: str):
    def make(v):
        both = [Field(f"{path}[{i}]").number(v) for i in (0, 1)]
        return F.when((both[0] >= 0) & (both[1] >= 0) & Field(f"{path}[2]").at(v).isNull(), F.array(*both))
    return make


def share(part: str, total: str, edges: Sequence[float], labels: Sequence[str]):
    def make(v):
        a, b = Field(part).number(v, True), Field(total).number(v, True)
        return F.when(b > 0, bucket(100 * a / F.when(b > 0, b), edges, labels))
    return make


def renamed(path: str, names: dict[str, str]):
    return lambda v: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[Field(path).text(v)]


_RATE = ((1, 5, 15, 50), ("<1", "1-5", "5-15", "15-50", ">50"))
#: The fields that a submission may carry, in order, with their paths, vocabularies and bands.
FIELDS = {
    "background_pdr_hz": within("background.pdr_hz", 0.5, 20),
    "swi_pct_by_stage": stages("swi.swi_per_stage_pct"),
    "csws_criterion_met": flag("swi.csws_criterion_met"),
    "csws_threshold_pct": within("swi.csws_threshold_pct", 0, 100),
    "spindle_density_per_min_central": within("spindles.density_per_minute", 0, 100, True),
    "spindle_age_norm_range": pair("spindles.age_normative_range"),
    "spindle_interpretation": word("spindles.interpretation", "below", "in", "above", "no_age_provided", "no_data"),
    "activation_factor": within("state_split.activation_factor", 0, 10_000, True),
    "activation_label": word("state_split.activation_label", "none", "mild", "moderate", "strong", "indeterminate"),
    "morphology_events_per_min": within("morphology.events_per_minute", 0, 10_000, True),
    "morphology_spike_wave_pct": within("morphology.pct_complex_spike_wave", 0, 100),
    "sleep_stages_pct": stages("sleep_stages.stage_pct", "sleep_stages.stages_pct"),
    "n_sleep_cycles": lambda v: F.when(Field("sleep_architecture.n_cycles").number(v, True).between(0, 100), Field("sleep_architecture.n_cycles").number(v, True).cast("int")),
    "quality_grade": word("quality.grade", "A", "B", "C", "D", "unknown"),
    "coupling_plv_bucket": band("coupling.plv", (0.1, 0.2, 0.35, 0.5), ("<0.1", "0.1-0.2", "0.2-0.35", "0.35-0.5", ">0.5")),
    "coupling_preferred_phase_octant": octant("coupling.preferred_phase_deg"),
    "coupling_n_events_bucket": band("coupling.n_spindles_in_so", (10, 50, 200), ("<10", "10-50", "50-200", ">200"), whole=True),
    "coupling_rayleigh_significant": lambda v: F.when(Field("coupling.rayleigh_p").number(v) >= 0, Field("coupling.rayleigh_p").number(v) < 0.05),
    "sw_density_bucket": band("slow_waves.density_per_minute", (5, 15, 30, 50), ("<5", "5-15", "15-30", "30-50", ">50")),
    "sw_mean_ptp_bucket": band("slow_waves.mean_ptp_uv", (75, 150, 250), ("<75", "75-150", "150-250", ">250")),
    "sw_method": word("slow_waves.method", "yasa", "heuristic"),
    "hfo_rate_bucket": band("hfo_ripples.rate_per_minute_nrem", (1, 5, 15), ("<1", "1-5", "5-15", ">15"), "0"),
    "hfo_available": flag("hfo_ripples.available"),
    "hfo_pct_on_spike_bucket": share("hfo_ripples.n_ripples_on_spike", "hfo_ripples.n_ripples_total", (10, 50, 90), ("<10", "10-50", "50-90", ">90")),
    "ied_method": word("ied_ml.method", "external_spikenet", "ensemble_heuristic", "unavailable"),
    "ied_rate_bucket": band("ied_ml.rate_per_minute", *_RATE, "0"),
    "ied_age_flag": word("ied_ml.age_appropriateness_flag", "ok", "drift_warning", "untested"),
    "ied_agreement_bucket": band("ied_ml.agreement_with_morphology_pct", (50, 75, 90), ("<50", "50-75", "75-90", ">90"), most=100.5),
    "ied_n_rolandic_benign_bucket": band("ied_ml.n_likely_rolandic_benign", (10, 50), ("small", "medium", "large"), "0", whole=True),
    "ied_nrem_rate_bucket": band("ied_ml.nrem_rate_per_min", *_RATE, "0"),
    "aperiodic_chi_n2_bucket": band("aperiodic.chi_by_state.n2.median", (1.5, 2.0, 2.5), ("<1.5", "1.5-2.0", "2.0-2.5", ">2.5")),
    "pdr_asymmetry_bucket": renamed("background.asymmetry_interpretation", {"symmetric": "symmetric", "not_computed": "symmetric", "lh_dominant": "lh_dominant", "rh_dominant": "rh_dominant", "marked_asymmetric": "marked"}),
    "microstate_dominant": word("microstates.dominant_microstate", "A", "B", "C", "D"),
    "spike_topography_pattern": word("pattern_recognition.spike_topography_pattern", "centro_temporal_BCECTS", "multifocal", "generalized", "frontal_dominant", "occipital_dominant", "lateralized_right", "lateralized_left", "indeterminate"),
    "spike_morphology_polyspike_pct_bucket": band("pattern_recognition.morphology_subtypes.pct_polyspike", (5, 20, 50), ("<5", "5-20", "20-50", ">50"), "0"),
    "sleep_activation_classification": word("pattern_recognition.sleep_activation_classification", "wake_dominant_atypical", "no_activation", "mild_activation", "moderate_activation", "strong_activation_eses_risk", "indeterminate"),
    "csws_risk_score_bucket": band("pattern_recognition.csws_risk_score", (0.2, 0.4, 0.6, 0.8), ("<0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", ">0.8")),
}


def allowed_findings(findings: Column) -> Column:
    """A struct of the allowed fields of a findings document (a variant); what is missing, of another type or outside its range is null, all else is left behind."""
    return F.struct(*[make(findings).alias(name) for name, make in FIELDS.items()])


#: Fixed value: the version of the consent text that holds.
CONSENT_VERSION = 2
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
_AGES = ((1, 2, 3, 5, 7, 10, 13, 18, 30), ("0-1", "1-2", "2-3", "3-5", "5-7", "7-10", "10-13", "13-18", "18-30", "30+"))
_HOURS = ((1, 4, 12, 24, 48), ("<1", "1-4", "4-12", "12-24", "24-48", "48+"))
#: The rules that an input must keep, by name; a rule that is unknown, as on a null, is broken.
INPUT_RULES = {
    "consent_given": "consent_given",
    "consent_version": f"consent_version = {CONSENT_VERSION}",
    "submission_id": f"submission_id rlike '{_UUID}'",
    "month": r"submitted_at_month rlike '^[0-9]{4}-(0[1-9]|1[0-2])$'",
    "variant_gene": "variant_gene rlike '^[A-Z][A-Z0-9]{1,15}$'",
    "variant_protein": r"variant_protein rlike '^p[.][A-Z][a-z]{2}[0-9]{1,5}([A-Z][a-z]{2}|[*]|fs|del|dup)$'",
    "variant_type": "variant_type in ('missense_GoF', 'missense_LoF', 'missense_unknown', 'truncating', 'splice', 'deletion', 'duplication', 'regulatory', 'unknown')",
    "age_years": "age_years >= 0 and not isnan(age_years)",
    "sex": "sex in ('F', 'M', 'X', 'unknown')",
    "country_region": "country_region is null or country_region rlike '^[A-Z]{2}$'",
    "duration_hours": "duration_hours >= 0 and not isnan(duration_hours)",
    "montage": "montage in ('10-20_monopolar', '10-10_monopolar', '10-20_bipolar', 'double_banana', 'other_monopolar', 'other_bipolar', 'unknown')",
    "n_channels": "n_channels between 0 and 256",
    "intervention_type": "intervention_type is null or intervention_type in ('medication', 'diet', 'stimulation', 'behavioral', 'other')",
    "intervention_name": "intervention_type is null or (trim(intervention_name) <> '' and length(intervention_name) <= 64 and not intervention_name rlike '[^\\\\x00-\\\\x7F]')",
    "intervention_record_kind": "intervention_type is null or intervention_record_kind in ('baseline', 'pre', 'post', 'followup')",
    "linked_pre_submission_id": f"intervention_type is null or linked_pre_submission_id is null or linked_pre_submission_id rlike '{_UUID}'",
}


def build_submissions(df: DataFrame, findings: str = "findings") -> DataFrame:
    """G1: submission_id, errors, document: a document of allowed fields for each row whose input keeps INPUT_RULES, or the names of the rules that it breaks.

    ``df`` has the inputs that the rules name (one row a submission_id), had_sleep, tool_version, and a JSON text of findings (null and invalid ones count as empty). Ages and durations leave
    as bands only. A document in whose strings the identifier scan finds anything is withheld: its errors are "scan:" and what was found, with the path."""
    v = F.coalesce(F.try_parse_json(findings), F.parse_json(F.lit("{}")))
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in INPUT_RULES.items()]))
    does = F.col("intervention_type").isNotNull()
    doc = F.struct(F.lit(2).alias("schema_version"), "submission_id", "submitted_at_month", "tool_version",
                   F.struct("variant_gene", "variant_protein", "variant_type").alias("variant"),
                   F.struct(bucket(F.col("age_years"), *_AGES).alias("age_bucket"), "sex", "country_region").alias("demographics"),
                   F.struct(bucket(F.col("duration_hours"), *_HOURS).alias("duration_bucket"), "montage", "n_channels", F.coalesce("had_sleep", F.lit(False)).alias("had_sleep")).alias("recording"),
                   F.when(does, F.struct(F.col("intervention_type").alias("type"), F.trim("intervention_name").alias("name"), F.col("intervention_record_kind").alias("record_kind"), "linked_pre_submission_id")).alias("intervention"),
                   allowed_findings(v).alias("findings"))
    made = df.select("submission_id", errors.alias("errors"), F.to_json(doc).alias("document"))
    made = saved(made.withColumn("document", F.when(F.size("errors") == 0, F.col("document"))), "submissions")
    dirty = scan_documents(made, ["submission_id"], "document")
    dirty = dirty.select("submission_id", F.explode("findings").alias("f"), "path").groupBy("submission_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("scan:"), F.col("f"), F.lit(" at "), F.col("path")))).alias("scan"))
    out = made.join(dirty, "submission_id", "left")
    return out.select("submission_id", F.concat("errors", F.coalesce("scan", F.array().cast("array<string>"))).alias("errors"), F.when(F.col("scan").isNull(), F.col("document")).alias("document"))
