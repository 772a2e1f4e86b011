"""Walks, scans and submissions: one failing case for every rule, and documents full of what must not leave."""

import json
import random
import uuid

from wavelake.functions import registry

GOOD = {"consent_given": True, "consent_version": 2, "submitted_at_month": "2026-05", "tool_version": "0.1", "variant_gene": "SCN1A", "variant_protein": "p.Arg230His", "variant_type": "missense_GoF", "age_years": 5.5, "sex": "F",
        "country_region": "DE", "duration_hours": 8.0, "montage": "10-20_monopolar", "n_channels": 19, "had_sleep": True, "intervention_type": None, "intervention_name": None, "intervention_record_kind": None,
        "linked_pre_submission_id": None}
SCHEMA = ("submission_id string, consent_given boolean, consent_version int, submitted_at_month string, tool_version string, variant_gene string, variant_protein string, variant_type string, age_years double, sex string, "
          "country_region string, duration_hours double, montage string, n_channels int, had_sleep boolean, intervention_type string, intervention_name string, intervention_record_kind string, linked_pre_submission_id string, findings string")


def build(spark, cases):
    rows = [{"submission_id": str(uuid.UUID(int=i, version=4)), "findings": json.dumps(f) if not isinstance(f, str) and f is not None else f} | GOOD | c for i, (c, f) in enumerate(cases)]
    ids = [r["submission_id"] for r in rows]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    got = {r.submission_id: r for r in registry.build_submissions(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)).collect()}
    return [got[i] for i in ids]


def test_every_rule_has_a_case_that_breaks_it(spark):
    act = {"intervention_type": "medication", "intervention_name": "Drug", "intervention_record_kind": "post"}
    bad = [({"variant_gene": "scn1a"}, "variant_gene"), ({"variant_gene": "K"}, "variant_gene"), ({"variant_gene": "GENE_WITH_UNDERSCORE"}, "variant_gene"), ({"variant_protein": "R230H"}, "variant_protein"),
           ({"variant_protein": "p.JohnSmith"}, "variant_protein"), ({"variant_type": "GoF"}, "variant_type"), ({"sex": "female"}, "sex"), ({"country_region": "Germany"}, "country_region"), ({"age_years": -3.0}, "age_years"),
           ({"age_years": float("nan")}, "age_years"), ({"age_years": None}, "age_years"), ({"montage": "custom_clinic"}, "montage"), ({"n_channels": 999}, "n_channels"), ({"n_channels": None}, "n_channels"),
           ({"consent_given": False}, "consent_given"), ({"consent_version": 0}, "consent_version"), ({"duration_hours": -1.0}, "duration_hours"), ({"submitted_at_month": "2026-13"}, "month"), ({"submission_id": "x"}, "submission_id"),
           (act | {"intervention_name": "A" * 100}, "intervention_name"), (act | {"intervention_name": " "}, "intervention_name"), (act | {"intervention_name": "Аbc"}, "intervention_name"),
           (act | {"intervention_type": "magic"}, "intervention_type"), (act | {"intervention_record_kind": "x"}, "intervention_record_kind"), (act | {"linked_pre_submission_id": "y"}, "linked_pre_submission_id")]
    assert {name for _, name in bad} == set(registry.INPUT_RULES)
    got = build(spark, [(c, {}) for c, _ in bad] + [({}, {}), (act, None), ({"country_region": None}, "no json")])
    for (case, name), r in zip(bad, got, strict=False):
        assert r.errors == [name] and r.document is None, case
    assert all(r.errors == [] and r.document for r in got[len(bad):])
    doc = json.loads(got[-3].document)
    assert doc["demographics"]["age_bucket"] == "5-7" and doc["recording"]["duration_bucket"] == "4-12" and "intervention" not in doc and doc["findings"] == {} and "age_years" not in got[-3].document


FULL = {"background": {"pdr_hz": 9.5, "asymmetry_interpretation": "marked_asymmetric"}, "swi": {"swi_per_stage_pct": {"N2": 40.5, "N3": 101, "Bob": 3}, "csws_criterion_met": False, "csws_threshold_pct": 85},
        "spindles": {"density_per_minute": 3, "age_normative_range": [2, 5.5], "interpretation": "in"}, "state_split": {"activation_factor": 2.5, "activation_label": "mild"},
        "morphology": {"events_per_minute": 12.25, "pct_complex_spike_wave": 0}, "sleep_stages": {"stage_pct": {}, "stages_pct": {"WAKE": 10, "REM": 20.5}}, "sleep_architecture": {"n_cycles": 4}, "quality": {"grade": "A"},
        "coupling": {"plv": 0.35, "preferred_phase_deg": 180, "n_spindles_in_so": 200, "rayleigh_p": 0.01}, "slow_waves": {"density_per_minute": 4.99, "mean_ptp_uv": 150, "method": "heuristic"},
        "hfo_ripples": {"rate_per_minute_nrem": 0, "available": True, "n_ripples_total": 10, "n_ripples_on_spike": 9},
        "ied_ml": {"method": "unavailable", "rate_per_minute": 50, "age_appropriateness_flag": "ok", "agreement_with_morphology_pct": 100.2, "n_likely_rolandic_benign": 9, "nrem_rate_per_min": 0.5},
        "aperiodic": {"chi_by_state": {"n2": {"median": 2.25}}}, "microstates": {"dominant_microstate": "C"},
        "pattern_recognition": {"spike_topography_pattern": "multifocal", "morphology_subtypes": {"pct_polyspike": 0}, "sleep_activation_classification": "no_activation", "csws_risk_score": 0.8}}
WANT = {"background_pdr_hz": 9.5, "swi_pct_by_stage": {"N2": 40.5}, "csws_criterion_met": False, "csws_threshold_pct": 85.0, "spindle_density_per_min_central": 3.0, "spindle_age_norm_range": [2.0, 5.5], "spindle_interpretation": "in",
        "activation_factor": 2.5, "activation_label": "mild", "morphology_events_per_min": 12.25, "morphology_spike_wave_pct": 0.0, "sleep_stages_pct": {"WAKE": 10.0, "REM": 20.5}, "n_sleep_cycles": 4, "quality_grade": "A",
        "coupling_plv_bucket": "0.35-0.5", "coupling_preferred_phase_octant": "[135,180]", "coupling_n_events_bucket": ">200", "coupling_rayleigh_significant": True, "sw_density_bucket": "<5", "sw_mean_ptp_bucket": "150-250", "sw_method": "heuristic",
        "hfo_rate_bucket": "0", "hfo_available": True, "hfo_pct_on_spike_bucket": ">90", "ied_method": "unavailable", "ied_rate_bucket": ">50", "ied_age_flag": "ok", "ied_agreement_bucket": ">90", "ied_n_rolandic_benign_bucket": "small",
        "ied_nrem_rate_bucket": "<1", "aperiodic_chi_n2_bucket": "2.0-2.5", "pdr_asymmetry_bucket": "marked", "microstate_dominant": "C", "spike_topography_pattern": "multifocal", "spike_morphology_polyspike_pct_bucket": "0",
        "sleep_activation_classification": "no_activation", "csws_risk_score_bucket": ">0.8"}


def test_all_fields_and_nothing_else(spark):
    assert len(registry.FIELDS) == 37 and set(WANT) == set(registry.FIELDS)
    rng = random.Random(4)
    secrets = ["patient John Doe", "DOB 2020-01-15", "MRN 123456789", "family@example.com", "/home/jane/eeg.edf", "+49 170 1234567"]

    def spoiled(x, depth=0):
        """The same tree with texts in place of values, and keys that no one asked for."""
        if isinstance(x, dict):
            return {k: spoiled(v, depth + 1) for k, v in x.items()} | {rng.choice(secrets): rng.choice(secrets), "more": [rng.choice(secrets)]}
        return [rng.choice(secrets)] if rng.random() < 0.2 else rng.choice(secrets) if rng.random() < 0.7 else x

    got = build(spark, [({}, FULL)] + [({}, spoiled(FULL)) for _ in range(60)])
    assert got[0].errors == [] and json.loads(got[0].document)["findings"] == WANT
    for r in got[1:]:
        found = json.loads(r.document)["findings"]
        assert r.errors == [] and not any(s in r.document for s in secrets) and all(v == WANT[k] or isinstance(v, (dict, list)) for k, v in found.items())


def test_a_document_that_the_scan_objects_to_is_withheld(spark):
    act = {"intervention_type": "medication", "intervention_record_kind": "post"}
    got = build(spark, [(act | {"intervention_name": n}, {}) for n in ("Levetiracetam", "John Smith", "given 2020-01-15", "ask a.b@example.com")])
    assert got[0].errors == [] and all(r.document is None for r in got[1:])
    assert got[1].errors == ["scan:name_like at $.intervention.name"] and got[2].errors[0].startswith("scan:iso_date") and got[3].errors == ["scan:email at $.intervention.name"]


def test_walk_and_scan_of_nested_documents(spark):
    docs = {1: {"a": [1, {"b": "call 2020-01-15", "c": None}, [True, "x"]], "d": {}, "e": []}, 2: "just a text", 3: 7.5, 4: {"submission_id": "2020-01-15", "findings": {"sw_method": "John Doe", "note": "John Doe"}}, 5: {"n": "Ｊｏｈｎ Ｄｏｅ"}}
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [(6, "{not json"), (7, None), (8, json.dumps({"deep": json.loads("[" * 12 + '"z"' + "]" * 12)}))]
    df = spark.createDataFrame(rows, "k int, doc string")
    got = {(r.k, r.path): (r.kind, r.text) for r in registry.walk(df, ["k"], "doc").collect()}
    assert got == {(1, "$.a[0]"): ("BIGINT", "1"), (1, "$.a[1].b"): ("STRING", "call 2020-01-15"), (1, "$.a[1].c"): ("VOID", None), (1, "$.a[2][0]"): ("BOOLEAN", "true"), (1, "$.a[2][1]"): ("STRING", "x"), (2, "$"): ("STRING", "just a text"),
                   (3, "$"): ("DECIMAL", "7.5"), (4, "$.submission_id"): ("STRING", "2020-01-15"), (4, "$.findings.sw_method"): ("STRING", "John Doe"), (4, "$.findings.note"): ("STRING", "John Doe"),
                   (5, "$.n"): ("STRING", docs[5]["n"]), (6, "$"): ("INVALID", "{not json"), (8, "$.deep" + "[0]" * 12): ("STRING", "z")}
    found = {(r.k, r.path): r.findings for r in registry.scan_documents(df, ["k"], "doc").collect()}
    assert found == {(1, "$.a[1].b"): ["iso_date", "numeric_date"], (4, "$.findings.note"): ["name_like"], (5, "$.n"): ["name_like", "foreign_letter"]} or found == {
        (1, "$.a[1].b"): ["iso_date"], (4, "$.findings.note"): ["name_like"], (5, "$.n"): ["name_like", "foreign_letter"]}
    assert registry.walk(df.limit(0), ["k"], "doc").count() == 0
