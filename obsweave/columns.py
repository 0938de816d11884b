"""Column naming and the fixed vocabularies shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Columns:
    """Names of the input columns; every operator takes one of these.

    ``occ_id`` is the row identity.  It orders rows and spreads hot keys, so it
    should be close to unique.
    """

    occ_id: str = "occ_id"
    kingdom: str = "kingdom"
    phylum: str = "phylum"
    class_: str = "class"
    order: str = "tax_order"
    family: str = "family"
    genus: str = "genus"
    species: str = "species"
    lon: str = "lon"
    lat: str = "lat"
    uncertainty: str = "uncertainty_m"
    basis: str = "basis_of_record"
    event_date: str = "event_date"
    year: str = "year"
    month: str = "month"
    day: str = "day"
    collector: str = "recorded_by"
    country: str = "country_code"
    status: str = "occurrence_status"
    has_issue: str = "has_geospatial_issue"

    @property
    def ranks(self) -> dict[str, str]:
        """Rank name -> column name, from the broadest to the finest."""
        return {
            "kingdom": self.kingdom,
            "phylum": self.phylum,
            "class": self.class_,
            "order": self.order,
            "family": self.family,
            "genus": self.genus,
            "species": self.species,
        }


# The quality flags, in reporting order, with their description.
FLAGS: dict[str, str] = {
    "flag_missing_coords": "longitude or latitude absent",
    "flag_high_uncertainty": "coordinate uncertainty of 10 km or more",
    "flag_inappropriate_basis": "fossil or living specimen",
    "flag_missing_species": "no species name",
    "flag_invalid_date": "date absent, before 1950 or in the future",
    "flag_duplicate": "same species, place and date as another record",
    "flag_coord_capitals": "within 10 km of a capital",
    "flag_coord_centroids": "within 5 km of a country or province centroid",
    "flag_coord_equal": "longitude and latitude have equal size",
    "flag_coord_hq": "at the provider's headquarters",
    "flag_coord_zeros": "on a zero axis or near (0, 0)",
    "flag_coord_urban": "inside an urban polygon",
    "flag_coord_outliers": "far from the other records of its species",
    "flag_any_coord_issue": "any of the seven coordinate tests",
}

# The seven coordinate tests.
COORD_FLAGS: tuple[str, ...] = (
    "flag_coord_capitals",
    "flag_coord_centroids",
    "flag_coord_equal",
    "flag_coord_hq",
    "flag_coord_zeros",
    "flag_coord_urban",
    "flag_coord_outliers",
)

# A strategy or preset keeps the rows on which none of its flags is set.
STRATEGIES: dict[str, tuple[str, ...]] = {
    "minimal": ("flag_missing_coords", "flag_missing_species"),
    "moderate": (
        "flag_missing_coords", "flag_missing_species",
        "flag_invalid_date", "flag_any_coord_issue",
    ),
    "strict": (
        "flag_missing_coords", "flag_missing_species",
        "flag_invalid_date", "flag_any_coord_issue",
        "flag_high_uncertainty", "flag_inappropriate_basis", "flag_duplicate",
    ),
}
PRESETS: dict[str, tuple[str, ...]] = {
    "spatial": (
        "flag_missing_coords", "flag_missing_species", "flag_invalid_date",
        "flag_coord_equal", "flag_coord_hq", "flag_coord_zeros",
    ),
    "temporal": ("flag_invalid_date", "flag_missing_species"),
    "taxonomic": ("flag_missing_species",),
    "model": (
        "flag_missing_coords", "flag_missing_species", "flag_invalid_date",
        "flag_coord_equal", "flag_coord_hq", "flag_coord_zeros",
        "flag_coord_outliers",
    ),
}

# Specimen kinds that are not natural occurrences.
UNSUITABLE_BASIS: tuple[str, ...] = ("FOSSIL_SPECIMEN", "LIVING_SPECIMEN")

EARTH_RADIUS_M = 6371008.8
KM_PER_DEGREE = 111.0
