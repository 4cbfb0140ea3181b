"""Parameters of all operators, with the values of a football broadcast."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fixed values that right results depend on.
    min_confidence: float = 0.1
    frame_rate: float = 25.0
    window_frames: int = 5
    camera_threshold: float = 5.0
    ball_radius: float = 70.0
    mask_ranges: tuple[tuple[float, float], ...] = ((0.0, 20.0), (900.0, 1050.0))
    polygon: tuple[tuple[float, float], ...] = ((110.0, 1035.0), (265.0, 275.0), (910.0, 260.0), (1640.0, 915.0))
    pitch: tuple[tuple[float, float], ...] = ((0.0, 0.0), (0.0, 23.32), (68.0, 23.32), (68.0, 0.0))
    #: The map from the polygon to the pitch, both in single precision; for other corners see
    #: :func:`touchline.functions.geometry.solve_homography`.
    homography: tuple[float, ...] = (
        0.21888134936997805, 0.04464027520045604, -70.27963326316959,
        -0.005306128172663865, -0.06765313420146424, 70.60466799750851,
        -5.9823044554659536e-05, 0.00431056087175743, 1.0,
    )
    max_corners: int = 100
    corner_quality: float = 0.3
    corner_spacing: float = 3.0
    detection_batch: int = 20
    # Choices where the loops that these operators restate leave one.
    min_iou: float = 0.3
    kmeans_rounds: int = 100  #: that 2-means may take to settle
    block_frames: int = 50_000  #: of a match that a scan in order of frames holds in one task
    cell: int = 64  #: pixels of a side of the grid by which frames meet boxes
    centre_classes: tuple[str, ...] = ()  #: objects whose position is the box's centre, not its foot
    cumulative_camera: bool = False  #: add camera movements up instead of taking each frame's own
    reposition_balls: bool = False  #: give filled balls positions again
    no_speed: tuple[str, ...] = ("balls",)


DEFAULTS = Params()
