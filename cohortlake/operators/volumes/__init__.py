"""Volume operators.

A volume is many rows, one per 2-D slice: ``slabs(scan_id, c, z, nx, ny, nz, px)``, where
``px[x * ny + y]`` holds voxel (x, y, z) of channel c.  Work inside a slice is array
expressions and needs no shuffle; work across slices moves slices, never whole volumes.
"""
