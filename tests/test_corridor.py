"""Cells of a corridor are counted once, wherever they lie."""

from terrapace.operators import corridor


def test_cells_are_counted_in_words(spark):
    line = spark.createDataFrame([(1, k, lon, lat, 0.0) for k, (lon, lat) in enumerate([(-0.001, -0.0005), (0.001, 0.0005), (-0.001, -0.0005)])], "route_id long, seq int, lon double, lat double, z double")
    found = corridor.buffer_cells(corridor.line_segments(line), 50.0)
    one_way = corridor.buffer_cells(corridor.line_segments(line.where("seq < 2")), 50.0).first().area_ha
    length = ((0.002 * 111320 * 0.78) ** 2 + (0.001 * 110574) ** 2) ** 0.5
    assert found.first().area_ha == one_way and abs(one_way - (length * 100 + 3.14159 * 2500) / 1e4) < 0.05
    assert "cx" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[2].split("\n")[0].split("],")[0]  # a task's table has words, not cells
