"""Settings: window lengths of features, exported features by transcript type, genome file paths."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field

#: Window length of each feature; any other has DEFAULT_LENGTH.
DEFAULT_LENGTH = 50
FEATURE_LENGTHS = {
    "five_prime_UTR": 100, "three_prime_UTR": 150, "intron": 500, "exon": 100, "first_exon": 100, "last_exon": 100,
    "CDS": 100, "first_CDS": 100, "last_CDS": 100, "3p_duplex": 20, "5p_duplex": 20, "mature": 20, "hairpin": 10,
    "pri_mir": 500, "start_codon": 3, "stop_codon": 3, "branchpoint": 50, "branchpoint_pred": 50, "full_CDS": 200,
}
#: Features exported for every transcript, and those that a type adds.
BASE_FEATURES = ["first_exon", "exon", "intron", "branchpoint", "branchpoint_pred", "last_exon", "polyAsite", "polyAsignal"]
TYPE_FEATURES = {
    "protein_coding": ["five_prime_UTR", "first_CDS", "CDS", "last_CDS", "three_prime_UTR"],
    "snoRNA": ["BoxACA", "BoxC", "BoxD", "BoxH", "Duplex"],
    "tRNA": ["anticodon", "t_loop", "d_loop", "v_loop", "anticodon_loop"],
    "miRNA": ["5p_duplex", "3p_duplex", "mature"],
    "vaultRNA": [], "lncRNA": [], "RNU": [], "circRNA": [], "YRNA": [], "rRNA": [],
}


def features_of(kind: str) -> list[str]:
    return BASE_FEATURES + TYPE_FEATURES.get(kind, [])


@dataclass(frozen=True)
class Settings:
    """Immutable settings; `with_length` gives a changed copy instead of altering a global table."""

    files: dict[str, str] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=lambda: dict(FEATURE_LENGTHS))

    def length(self, feature: str) -> int:
        return self.lengths.get(feature, DEFAULT_LENGTH)

    def with_length(self, feature: str, length: int) -> Settings:
        return Settings(self.files, self.lengths | {feature: length})

    @classmethod
    def from_ini(cls, path: str) -> Settings:
        """Reads the [FILES] section; empty values stay as empty strings."""
        parser = configparser.ConfigParser()
        parser.optionxform = str
        with open(path, encoding="utf-8") as f:
            parser.read_file(f)
        return cls(dict(parser["FILES"]) if parser.has_section("FILES") else {})
