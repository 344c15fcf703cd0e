"""Record schemas and the allowed values of their enumerations."""

from __future__ import annotations

#: Schemas are DDL strings, which readers take as they are.
REFERENCE = "book string, chapter int, verse_start int, verse_end int"
CASE = "case_id string, translation string, reference struct<book:string,chapter:int,verse_start:int,verse_end:int>, stratum string, prompt_variant string"
REFERENCE_RECORD = "translation string, reference struct<book:string,chapter:int,verse_start:int,verse_end:int>, text string"
EDITION = "id string, name string, abbreviation string, edition string, license_kind string, license_url string, source_url string, redistribute_reference_text boolean"
CATALOG = "schema_version int, translations array<struct<id:string,name:string,abbreviation:string,edition:string,license_kind:string,license_url:string,source_url:string,redistribute_reference_text:boolean>>"
EXECUTION = "struct<input_tokens:decimal(20,0),output_tokens:decimal(20,0),stop_reason:string,truncated:boolean,refusal:boolean,accounted_nanoeur:decimal(20,0),reservation_retained:boolean>"
RESPONSE = f"case_id string, run_id string, provider string, model string, resolved_model string, output string, error string, temperature float, reasoning_effort string, seed decimal(20,0), provider_request_id string, system_fingerprint string, execution {EXECUTION}"
CURATED = "reference struct<book:string,chapter:int,verse_start:int,verse_end:int>, stratum string"
LOCK = "schema_version int, translation string, edition string, source_url string, source_sha256 string, importer_version string, artifacts array<struct<path:string,sha256:string,bytes:decimal(20,0)>>, reference_count bigint, corpus_sha256 string"

#: Enumerations as they stand in files.
STRATA = ("extremely_famous", "well_known", "moderate", "random", "obscure", "very_obscure", "translation_sensitive", "similar_translations", "short_verse", "long_verse", "passage")
VARIANTS = ("canonical", "concise", "word_for_word", "copy_control")
LICENSES = ("public_domain", "licensed_private")
CLASSES = ("exact_requested", "translation_confusion", "extraneous_text", "refusal", "empty", "provider_error", "truncated", "partial")


def camel(name: str) -> str:
    """A snake_case value as a type's variant name, by which some outputs are ordered or labelled."""
    return "".join(part.capitalize() for part in name.split("_"))
