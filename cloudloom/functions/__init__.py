"""Column functions: space-filling curves, voxel hashes, colours, arrays and screen geometry."""
