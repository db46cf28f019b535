"""Parameters of the image operators, as one frozen value instead of module state."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Defaults that results must share with published feature rows.
    denoise: str = "bilateral"
    bilateral: tuple = (9, 75.0, 75.0)  # diameter, colour sigma, space sigma
    hds: tuple = (200, 0.05, 0.15, 1.3, 1.0, 1e-8)  # iterations, lambda, dt, g, h, epsilon
    apc: tuple = (2.5, 0.6)  # sigma, alpha
    log_sigma: float = 4.0
    canny: tuple = (0.1, 0.25)
    nucleus_close: int = 3
    cell_close: int = 5
    min_area: int = 100
    train: float = 0.7
    val: float = 0.15
    seed: int = 42
    reference_images: int = 20
    classes: dict = field(default_factory=lambda: {"Benign": (0, 0), "Early": (1, 1), "Pre": (1, 2), "Pro": (1, 3)})
    suffixes: tuple = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


DEFAULT = Params()
MORPHOLOGY = ("nucleus_area", "nucleus_perim", "nucleus_eccentricity", "nucleus_solidity", "cell_area", "nc_ratio")
TEXTURE = ("glcm_contrast", "glcm_energy", "glcm_homogeneity", "glcm_correlation")
COLOUR = ("mean_R", "mean_G", "mean_B", "std_R", "std_G", "std_B")
MANIFEST = "image_id string, orig_path string, class_name string, class_id_binary int, class_id_4way int, split string"
FEATURES = "image_id string, class_name string, class_id_binary int, class_id_4way int, split string, " + ", ".join(f"{c} double" for c in (*MORPHOLOGY, *TEXTURE, *COLOUR))
LAYERS = "image_id string, split string, height int, width int, rgb binary, apc array<float>, log array<float>, canny array<boolean>, nucleus_mask array<boolean>, cell_mask array<boolean>"
