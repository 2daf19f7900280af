"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
input and the cores.  Results go to the no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chromatile.plans import load  # noqa: E402
from chromatile.session import local_session  # noqa: E402

HEADLINE = (
    "coverage_by_color color_features assign_nearest apply_tone exact_fill grain_fill hsl_fill knockout"
    " color_histogram range_stats bin_edges_even label_bins gray_world white_patch coverage_rollup"
    " kmeans_fit silhouette nearest_catalog load_catalog palette_manifest write_plates"
    " box_mean sobel morphology seam_mismatch axis_period resize crinkly_blend mesh_warp"
    " connected_boxes ink_mask stack_composite stream_label recent_colors debounce undo_redo dedupe_edits"
    " choose_k flatten_lighting mosaic_cells tile_from_motif frontier_fill best_wrap_crop best_shift"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load()
    queries["opaque_only"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
