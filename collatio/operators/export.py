"""A study's files: JSON, JSON lines of examples, Markdown and a page that shows them offline.

What is written here is a row a model, a group, a pair and an example, so the rows come to the driver.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from ..sources.records import write_json, write_text
from . import report
from .runs import EVIDENCE, SCHEMA_VERSION, Analysis

#: The tracks that an analysis may have.
TRACKS = ("canonical", "concise", "word_for_word", "copy_control", "passage")
#: Fixed value: resamples that an interval needs.
LEAST_RESAMPLES = 100
NOTES = (
    "Intervals are 95% percentile intervals of a stratified bootstrap over references; editions and repetitions of a reference stay together.",
    "Intervals of pairs are exploratory and not adjusted for many comparisons.",
    "Provider errors count as failures, and are left out of recall given success only.",
)
_METRICS = ("exact_text", "exact_words")


def study_report(found: Analysis) -> dict:
    """The analysis as one document."""
    models = {}
    for r in found.models.orderBy("identity").collect():
        own = r.asDict()
        name = own.pop("identity")
        models[name] = {k: v for k, v in own.items() if not k.startswith(_METRICS)} | {m: {k: own[f"{m}_{k}"] for k in ("estimate", "lower", "upper", "clusters", "resamples")} for m in _METRICS}
        models[name]["groups"] = {}
    for r in found.groups.orderBy("identity", "requested_translation", "stratum").collect():
        own = r.asDict()
        models[own.pop("identity")]["groups"][f"{own.pop('requested_translation')} / {own.pop('stratum')}"] = own
    pairs = [r.asDict() for r in found.comparisons.orderBy("left", "right").collect()]
    examples = [r.asDict() for r in found.examples.orderBy("model_key", "case_id", "run_id").collect()]
    return {"schema_version": SCHEMA_VERSION, "track": found.track, "evidence": found.evidence, "dataset_sha256": found.dataset_sha256, "notes": list(NOTES), "models": models, "comparisons": pairs, "examples": examples}


def artifact_faults(study: dict) -> list[str]:
    """What keeps a study from being shown."""
    faults = []
    if study.get("schema_version") != SCHEMA_VERSION or not study.get("models"):
        faults.append("an analysis with models is needed")
    if study.get("track") not in TRACKS or study.get("evidence") not in EVIDENCE:
        faults.append("unknown track or evidence")
    for name, m in (study.get("models") or {}).items():
        if not m.get("repetitions") or not m.get("cases_per_run"):
            faults.append(f"{name}: no completed observations")
        for metric in _METRICS:
            i = m.get(metric) or {}
            values = [i.get(k) for k in ("estimate", "lower", "upper")]
            if not i.get("clusters") or (i.get("resamples") or 0) < LEAST_RESAMPLES or any(v is None or not math.isfinite(v) or not 0 <= v <= 1 for v in values) or values[1] > values[2]:
                faults.append(f"{name}: invalid interval of {metric}")
    return faults


def escape(text: object) -> str:
    """Text in Markdown tables and headings. The characters and what stands for them."""
    out = str(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&#124;"), ("*", "&#42;"), ("[", "&#91;"), ("]", "&#93;"), ("`", "&#96;"), ("\n", " ")):
        out = out.replace(raw, safe)
    return out


def _percent(value: float | None) -> str:
    return "undefined" if value is None else f"{100 * value:.2f}%"


def _interval(i: dict) -> str:
    return f"{_percent(i['estimate'])} [95% CI {100 * i['lower']:.2f}, {100 * i['upper']:.2f}]"


def study_markdown(study: dict, found: Analysis | None = None) -> str:
    """The study as Markdown, with the report over all its scores at the end where the analysis is given."""
    lines = ["# Validated analysis", "", f"Evidence: **{study['evidence']}**. Track: **{study['track']}**.", "", *(f"- {n}" for n in study["notes"])]
    for name, m in study["models"].items():
        lines += ["", f"## {escape(name)}", "", f"{m['repetitions']} complete repetitions; {m['cases_per_run']} cases each; {m['exact_text']['clusters']} reference clusters.", ""]
        lines += [f"Exact text: {_interval(m['exact_text'])}. Exact words: {_interval(m['exact_words'])}.", "", f"Provider errors: {_percent(m['provider_error_rate'])}. Recall given success: {_percent(m['recall'])}.", ""]
        lines += [f"Cases whose editions differ: {m['differing_responses'] or 0}; exact text {_percent(m['differing_exact_text'])}.", "", "| Edition / stratum | Responses | Exact text |", "| --- | ---: | ---: |"]
        lines += [f"| {escape(g)} | {s['responses']} | {_percent(s['exact_text_rate'])} |" for g, s in m["groups"].items()]
    lines += ["", "## Paired comparisons", "", "Left less right, in percentage points."]
    lines += [f"\n- {escape(p['left'])} versus {escape(p['right'])}: {p['reason'] or _interval(p)}" for p in study["comparisons"]]
    lines += ["", "## Annotated failures", "", "The first of each kind by case; they illustrate and do not count."]
    for e in study["examples"]:
        lines += ["", f"### {escape(e['ref_label'])}: {escape(e['case_id'])} ({e['classification']}, {e['diagnostic']})", "", f"Model: {escape(e['model_key'])}. Requested edition: {escape(e['requested_translation'])}.", "", f"Expected: {escape(e['expected'])}", "", f"Produced: {escape(e['output'])}", "", f"Edits: {escape(e['word_diff'])}"]
    text = "\n".join(lines)
    if found is not None:
        text += "\n\n" + report.markdown(found.scores).replace("\n## ", "\n### ").replace("# Report", "## Report", 1)
    return "\n".join(x.rstrip() for x in text.splitlines()).rstrip() + "\n"


def script_safe(value: object) -> str:
    """JSON that may stand inside a script element. The characters and what stands for them."""
    out = json.dumps(value, ensure_ascii=False)
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = out.replace(raw, safe)
    return out


_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Analyses</title><style>body{font:15px sans-serif;margin:2em}td,th{padding:.2em .8em;text-align:left}</style>
<body><h1>Analyses</h1><div id="out"></div><script type="application/json" id="data">DATA</script><script>
const out = document.getElementById("out"), add = (tag, to, text) => { const e = document.createElement(tag); if (text !== undefined) e.textContent = text; to.append(e); return e; };
const show = i => `${(100 * i.estimate).toFixed(2)}% [${(100 * i.lower).toFixed(2)}, ${(100 * i.upper).toFixed(2)}]`;
for (const s of JSON.parse(document.getElementById("data").textContent)) {
  add("h2", out, `${s.track}, ${s.evidence}`); const t = add("table", out), h = add("tr", t);
  for (const x of ["Model", "Runs", "Exact text", "Exact words"]) add("th", h, x);
  for (const [name, m] of Object.entries(s.models)) { const r = add("tr", t); for (const x of [name, m.repetitions, show(m.exact_text), show(m.exact_words)]) add("td", r, x); }
  for (const p of s.comparisons) add("p", out, `${p.left} versus ${p.right}: ${p.reason || show(p)}`);
}
</script></body></html>
"""


def study_page(studies: list[dict]) -> str:
    """A page without outside parts that shows studies; unfit ones are an error."""
    if not studies:
        raise ValueError("at least one analysis is needed")
    if faults := [f for s in studies for f in artifact_faults(s)]:
        raise ValueError(faults[0])
    return _PAGE.replace("DATA", script_safe(studies), 1)


def export_study(found: Analysis, folder: str) -> dict:
    """Writes `analysis.json`, `examples.jsonl`, `analysis.md` and `analysis.html`; returns the document."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    study = study_report(found)
    page = study_page([study])
    write_json(study, str(at / "analysis.json"))
    write_text("".join(json.dumps(e, ensure_ascii=False, separators=(",", ":")) + "\n" for e in study["examples"]), str(at / "examples.jsonl"))
    write_text(study_markdown(study, found), str(at / "analysis.md"))
    write_text(page, str(at / "analysis.html"))
    return study
