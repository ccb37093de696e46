"""Job specification: thresholds, encoder, ontologies, inputs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

RDFS = "http://www.w3.org/2000/01/rdf-schema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
OWL = "http://www.w3.org/2002/07/owl#"
RDF_LABEL = RDFS + "label"
SUBCLASS_OF = RDFS + "subClassOf"
WELL_KNOWN = {"rdfs": RDFS, "rdf": RDF, "owl": OWL, "skos": "http://www.w3.org/2004/02/skos/core#"}


@dataclass(frozen=True)
class Path:
    predicate: str
    star: bool


def split_path(prop: str) -> Path:
    """``rdfs:subClassOf*`` is a path; other path operators are not supported."""
    prop = prop.strip()
    if prop.endswith("*"):
        return Path(prop[:-1], True)
    if not prop.startswith("<") and any(c in prop for c in "|+?^()") or prop.count("/") and ":" not in prop:
        raise ValueError(f"unsupported property path: {prop}")
    return Path(prop, False)


def iri_of(name: str, prefixes: dict[str, str]) -> str:
    """``<iri>``, a full IRI or ``prefix:name`` to the IRI."""
    name = name.strip()
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    if "://" in name or name.startswith("urn:"):
        return name
    prefix, colon, local = name.partition(":")
    iri = {**WELL_KNOWN, **prefixes}.get(prefix) if colon else None
    if iri is None:
        raise ValueError(f"unknown prefix in {name!r}")
    return iri + local


def object_of(value: str, prefixes: dict[str, str]) -> tuple[str, str]:
    """Constraint value to (kind, text): quoted strings, numbers and booleans are literals, the rest IRIs."""
    text = str(value).strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return "literal", text[1:-1]
    if text in ("true", "false", "True", "False"):
        return "literal", text.lower()
    try:
        float(text)
        return "literal", text
    except ValueError:
        return "iri", iri_of(text, prefixes)


@dataclass
class OntologySpec:
    name: str
    group: str
    prefix: str
    path: str | None = None
    format: str = "xml"
    label: str = RDF_LABEL
    properties: list[str] = field(default_factory=list)
    constraints: dict[str, str] = field(default_factory=dict)
    selected_prefix_term: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str | None = None


@dataclass
class TaxonSpec:
    work_dir: str | None = None
    regex: str | None = None
    cap: int = -1
    taxon_file: str = "taxon.tsv"
    vernacular_file: str = "vernacular_name.tsv"


def _listed(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


@dataclass
class AnnotationSpec:
    encoder: str = "hashing-384"
    threshold_chunk: float = 0.75
    threshold_tag: float = 0.75
    batch_size: int = 32
    force: bool = False
    abstracts_per_file: int = 100
    cap_terms: int = -1
    ontologies: list[OntologySpec] = field(default_factory=list)
    gbif: TaxonSpec | None = None
    ncbi: TaxonSpec | None = None
    abstract_files: list[str] = field(default_factory=list)
    abstract_dirs: list[str] = field(default_factory=list)
    compression: str = "none"  # of the published text files, say gzip

    @classmethod
    def from_json(cls, path: str) -> AnnotationSpec:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> AnnotationSpec:
        """Accepts ``encodeur`` and ``encoder``, ``json_file`` and ``json_files``, one path or a list of paths."""
        missing = [
            path
            for path in (
                "populate_owl_tag_embeddings",
                "populate_owl_tag_embeddings.ontologies",
                "populate_abstract_embeddings",
                "populate_abstract_embeddings.from_file",
            )
            if _dig(config, path) is None
        ]
        if missing:
            raise ValueError(f"missing sections: {', '.join(missing)}")
        owl, documents = config["populate_owl_tag_embeddings"], config["populate_abstract_embeddings"]
        source = documents["from_file"]
        prefixes = dict(owl.get("prefix", {}))
        ontologies = [
            OntologySpec(
                name=name,
                group=group,
                prefix=entry["prefix"],
                path=entry.get("filepath") or entry.get("url"),
                format=entry.get("format", "xml"),
                label=entry.get("label", RDF_LABEL),
                properties=_listed(entry.get("properties")),
                constraints=dict(entry.get("constraints", {})),
                selected_prefix_term=entry.get("selected_prefix_term"),
                prefixes=prefixes,
            )
            for group, members in owl["ontologies"].items()
            for name, entry in members.items()
        ]
        return cls(
            encoder=config.get("encodeur") or config.get("encoder") or cls.encoder,
            threshold_chunk=config.get("threshold_similarity_tag_chunk", 0.75),
            threshold_tag=config.get("threshold_similarity_tag", 0.75),
            batch_size=config.get("batch_size", 32),
            force=bool(config.get("force", False)),
            abstracts_per_file=documents.get("abstracts_per_file", 100),
            cap_terms=owl.get("debug_nb_terms_by_ontology", -1),
            ontologies=ontologies,
            gbif=_taxon(config.get("populate_gbif_taxon_tag_embeddings")),
            ncbi=_taxon(config.get("populate_ncbi_taxon_tag_embeddings")),
            abstract_files=_listed(source.get("json_files")) + _listed(source.get("json_file")),
            abstract_dirs=_listed(source.get("json_dir")),
        )


def _dig(config: dict[str, Any], path: str) -> Any:
    for key in path.split("."):
        config = config.get(key) if isinstance(config, dict) else None
    return config


def _taxon(section: dict[str, Any] | None) -> TaxonSpec | None:
    if section is None:
        return None
    return TaxonSpec(
        work_dir=section.get("work_dir"),
        regex=section.get("regex"),
        cap=section.get("debug_nb_taxon", -1),
        taxon_file=section.get("taxon_tsv_debug", "taxon.tsv"),
        vernacular_file=section.get("vernicular_tsv_debug", "vernacular_name.tsv"),
    )
