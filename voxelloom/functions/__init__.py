"""Part of voxelloom."""
