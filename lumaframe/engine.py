"""A fluent form of the operators: ``ImageFrame.open(spark, path).grayscale().canny(...).save(folder)``.

Every call adds to the lazy plan and gives a new frame; nothing runs before an action or a sink.
"""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color, pixel
from .operators import drawing, features, filters, geometry, histograms, segmentation
from .plans.kernels import apply_image, apply_stack, measure
from .schema import InvalidParameter, to_pixels
from .sources import images as sources


def _named(module: ModuleType, names: str) -> dict[str, Callable]:
    return {n: getattr(module, n) for n in names.split()}


#: Kernels over stacks of images, and over one image at a time.
STACKS = (
    _named(filters, "box_blur gaussian_blur median_blur filter2d laplacian_of_gaussian bilateral_filter sep_filter_2d sobel scharr laplacian dilate erode dilate_with_kernel erode_with_kernel")
    | _named(filters, "morph_open morph_close morphology_ex hit_or_miss thin skeleton distance_transform adaptive_threshold nlm_photo nlm")
    | _named(geometry, "resize crop flip rotate transpose warp_affine warp_perspective remap undistort pyr_down pyr_up integral_image")
    | _named(histograms, "equalize_hist equalize_hist_color clahe equalize_hist_adaptive threshold_otsu threshold_triangle")
)
IMAGES = (
    _named(segmentation, "connected_components watershed flood_fill canny inpaint")
    | _named(drawing, "draw_line draw_rectangle draw_circle draw_ellipse draw_polyline fill_poly draw_arrowed_line draw_marker draw_text")
    | _named(features, "template_match add_gaussian_noise add_speckle_noise add_salt_pepper_noise")
)
#: Results that are not images: name -> (type, kernel).
MEASURES = {
    "component_stats": (segmentation.STATS, segmentation.component_stats),
    "hough_lines_p": (segmentation.LINES, segmentation.hough_lines_p),
    "hough_circles": (segmentation.CIRCLES, segmentation.hough_circles),
    "find_contours": (segmentation.CONTOURS, segmentation.contour_hierarchy),
    "detect_keypoints": (features.KEYPOINTS, features.detect_keypoints),
    "hog": ("array<double>", histograms.hog),
}


class ImageFrame:
    def __init__(self, df: DataFrame):
        missing = {"image_id", "c", "h", "w", "data"} - set(df.columns)
        if missing:
            raise InvalidParameter(f"columns are missing: {sorted(missing)}")
        self.df = df

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ImageFrame:
        return cls(sources.read_images(spark, path))

    def __getattr__(self, name: str) -> Callable:
        if name in STACKS:
            return lambda **options: ImageFrame(apply_stack(self.df, lambda s: STACKS[name](s, **options)))
        if name in IMAGES:
            return lambda **options: ImageFrame(apply_image(self.df, lambda a: IMAGES[name](a, **options)))
        if name in MEASURES:
            kind, kernel = MEASURES[name]
            return lambda **options: measure(self.df, name, kind, lambda a: kernel(a, **options))
        raise AttributeError(name)

    def __dir__(self):
        return [*super().__dir__(), *STACKS, *IMAGES, *MEASURES]

    def _data(self, data, c: int | None = None) -> ImageFrame:
        df = self.df.withColumn("data", data)
        return ImageFrame(df.withColumn("c", F.lit(c)) if c else df)

    def grayscale(self) -> ImageFrame:
        return self._data(pixel.grayscale(F.col("data"), F.col("c"), F.col("h"), F.col("w")), 1)

    def to_rgb(self) -> ImageFrame:
        return self._data(pixel.to_rgb(F.col("data"), F.col("c")), 3)

    def threshold(self, thresh: float, maxval: float = 1.0, kind: str = "binary") -> ImageFrame:
        return self._data(pixel.threshold(F.col("data"), thresh, maxval, kind))

    def normalize(self, low: float = 0.0, high: float = 1.0) -> ImageFrame:
        return self._data(pixel.normalize(F.col("data"), F.col("c"), F.col("h"), F.col("w"), low, high))

    def convert(self, code: str) -> ImageFrame:
        return ImageFrame(color.convert(self.df, code))

    def _with(self, other: ImageFrame, f: Callable) -> ImageFrame:
        """Joins on the image; both sides keep their place where they are already dealt by it."""
        right = other.df.select("image_id", F.col("data").alias("_other"))
        df = self.df.join(right, "image_id")
        return ImageFrame(df.withColumn("data", f(F.col("data"), F.col("_other"))).drop("_other"))

    def add(self, other: ImageFrame) -> ImageFrame:
        return self._with(other, pixel.add)

    def subtract(self, other: ImageFrame) -> ImageFrame:
        return self._with(other, pixel.subtract)

    def absdiff(self, other: ImageFrame) -> ImageFrame:
        return self._with(other, pixel.absdiff)

    def pixels(self) -> DataFrame:
        return to_pixels(self.df)

    def histogram(self) -> DataFrame:
        return histograms.calc_hist(self.df)

    def save(self, folder: str, kind: str = "png") -> None:
        sources.save_images(self.df, folder, kind)
