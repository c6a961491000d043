"""Surface parameters translated from one public shading standard (OpenPBR) to another (Standard Surface), as a job over a table of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Parameters of the source model with their defaults; colours are three numbers.
DEFAULTS = {
    "base_weight": 1.0, "base_color": (0.8, 0.8, 0.8), "base_diffuse_roughness": 0.0, "base_metalness": 0.0,
    "specular_weight": 1.0, "specular_color": (1.0, 1.0, 1.0), "specular_roughness": 0.3, "specular_ior": 1.5, "specular_roughness_anisotropy": 0.0,
    "transmission_weight": 0.0, "transmission_color": (1.0, 1.0, 1.0), "transmission_depth": 0.0, "transmission_scatter": (0.0, 0.0, 0.0), "transmission_scatter_anisotropy": 0.0, "transmission_dispersion_scale": 0.0,
    "subsurface_weight": 0.0, "subsurface_color": (0.8, 0.8, 0.8), "subsurface_radius": 1.0, "subsurface_radius_scale": (1.0, 0.5, 0.25), "subsurface_scatter_anisotropy": 0.0,
    "fuzz_weight": 0.0, "fuzz_color": (1.0, 1.0, 1.0), "fuzz_roughness": 0.5,
    "coat_weight": 0.0, "coat_color": (1.0, 1.0, 1.0), "coat_roughness": 0.0, "coat_roughness_anisotropy": 0.0, "coat_ior": 1.6, "coat_darkening": 1.0,
    "thin_film_weight": 0.0, "thin_film_thickness": 0.5, "thin_film_ior": 1.4, "emission_luminance": 0.0, "emission_color": (1.0, 1.0, 1.0),
    "geometry_opacity": (1.0, 1.0, 1.0), "geometry_thin_walled": False,
}
#: Target parameters that take a source parameter as it is.
RENAMED = {
    "base": "base_weight", "diffuse_roughness": "base_diffuse_roughness", "metalness": "base_metalness", "specular": "specular_weight", "specular_color": "specular_color", "specular_IOR": "specular_ior", "specular_anisotropy": "specular_roughness_anisotropy",
    "transmission": "transmission_weight", "transmission_color": "transmission_color", "transmission_depth": "transmission_depth", "transmission_scatter": "transmission_scatter", "transmission_scatter_anisotropy": "transmission_scatter_anisotropy", "transmission_dispersion": "transmission_dispersion_scale",
    "subsurface": "subsurface_weight", "subsurface_radius": "subsurface_radius_scale", "subsurface_scale": "subsurface_radius", "subsurface_anisotropy": "subsurface_scatter_anisotropy", "sheen": "fuzz_weight", "sheen_color": "fuzz_color",
    "coat": "coat_weight", "coat_color": "coat_color", "coat_roughness": "coat_roughness", "coat_anisotropy": "coat_roughness_anisotropy", "coat_IOR": "coat_ior", "thin_film_IOR": "thin_film_ior",
    "emission": "emission_luminance", "emission_color": "emission_color", "opacity": "geometry_opacity", "thin_walled": "geometry_thin_walled",
}


def standard_surface(materials: DataFrame) -> DataFrame:
    """The target parameters of each material; source columns that are missing or null take their defaults, other columns are kept."""

    def given(name: str) -> Column:
        default = DEFAULTS[name]
        lit = F.array(*map(F.lit, default)) if isinstance(default, tuple) else F.lit(default)
        if name not in materials.columns:
            return lit
        one = isinstance(default, tuple) and not isinstance(materials.schema[name].dataType, ArrayType)  # a grey given as one number
        return F.coalesce(F.transform(F.when(F.col(name).isNotNull(), lit), lambda _: F.col(name).cast("double")) if one else F.col(name), lit)

    def blend(over: Column, under: Column, share: Column) -> Column:
        return F.zip_with(over, under, lambda a, b: b + (a - b) * share)

    f0 = F.pow((given("coat_ior") - 1) / (given("coat_ior") + 1), 2)
    inner = 1 - (1 - f0) / (given("coat_ior") * given("coat_ior"))  # light that the coat throws back inside
    metal = F.transform(given("base_color"), lambda c: c * given("specular_weight"))
    other = blend(given("subsurface_color"), given("base_color"), given("subsurface_weight"))
    below = blend(metal, other, given("base_metalness"))
    dark = F.transform(below, lambda c: 1 + ((1 - inner) / (1 - c * inner) - 1) * given("coat_weight") * given("coat_darkening"))
    darkened = lambda name: F.zip_with(given(name), dark, lambda a, b: a * b)
    made = {new: given(old) for new, old in RENAMED.items()} | {
        "base_color": darkened("base_color"),
        "subsurface_color": darkened("subsurface_color"),
        "specular_roughness": given("specular_roughness") + (given("coat_roughness") - given("specular_roughness")) * given("coat_weight"),
        "sheen_roughness": F.pow(given("fuzz_roughness"), 2.5),
        "coat_affect_roughness": F.lit(1.0),
        "thin_film_thickness": F.when(given("thin_film_weight") > 0, given("thin_film_thickness") * 1000).otherwise(0.0),
    }
    rest = [c for c in materials.columns if c not in DEFAULTS]
    return materials.select(*rest, *(c.alias(n) for n, c in made.items()))
