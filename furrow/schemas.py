"""Schemas of the tables between jobs, as Spark DDL."""

POINTS = "array<struct<x:double,y:double>>"

PROJECT_XML = "_name string, _mask string, image_dimensions string, image_origin string, pixel_size string, image_extents string, epsg string, projwtk string, seed int, prj string"
PROJECTS = (
    "prj string, name string, mask string, image_dimensions array<int>, image_origin array<int>, pixel_size array<double>, "
    "image_extents array<double>, epsg string, projwtk string, seed int"
)
RESULT_XML = "result string, buffer string, tile string, export string, kml string, epsg string, vectormask string, candidatelines long, resultinglines long, prj string"
TILE_IMAGES = "prj string, col int, row int, w int, h int, data binary"
CONTOURS = "prj string, col int, row int, contour_id int, pts array<struct<x:int,y:int>>"
LABELS = "prj string, col int, row int, px int, py int, label int"
