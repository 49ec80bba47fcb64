"""Optional HDF5 connector. It needs h5py; without it every call says so. Not verified where h5py is missing."""

from __future__ import annotations

import numpy as np

from countlake.sources.paths import InnerPath, inner_path


def library():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 needs the package h5py, which is not installed") from e
    return h5py


def read_pattern_arrays(path) -> tuple[int, list[np.ndarray]]:
    """(num_pix, [ones, multi, place_ones, place_multi, count_multi]) of a file of either version.

    Version 2 holds the five flat arrays; version 1 (or none stated) holds one ragged row per pattern.
    """
    with inner_path(path).open_group() as g:
        if str(g.attrs.get("version", "1")) == "2":
            return int(g.attrs["num_pix"]), [np.asarray(g[k]) for k in ("ones", "multi", "place_ones", "place_multi", "count_multi")]
        ragged = [list(g[k]) for k in ("place_ones", "place_multi", "count_multi")]
        sizes = [np.array([len(r) for r in x], np.int32) for x in ragged[:2]]
        flat = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in ragged]
        return int(np.asarray(g["num_pix"])), [*sizes, *flat]


def write_pattern_arrays(path, num_pix: int, sections: list[np.ndarray], version: str = "2", overwrite: bool = False, compression: str | None = None) -> None:
    h5, at = library(), inner_path(path)
    names = ("ones", "multi", "place_ones", "place_multi", "count_multi")
    with h5.File(at.file, "a") as f:
        g = f.require_group(at.name)
        if any(k in g for k in names):
            if not overwrite:
                raise FileExistsError(str(at))
            for k in (*names, "num_pix"):
                if k in g:
                    del g[k]
        g.attrs["version"] = version
        if version == "2":
            g.attrs["num_pix"], g.attrs["num_data"] = num_pix, len(sections[0])
            for k, x in zip(names, sections):
                g.create_dataset(k, data=np.asarray(x, "i4"), compression=compression)
        elif version == "1":
            g["num_pix"] = num_pix
            kind = h5.vlen_dtype(np.int32)
            for k, sizes, flat in (("place_ones", sections[0], sections[2]), ("place_multi", sections[1], sections[3]), ("count_multi", sections[1], sections[4])):
                d = g.create_dataset(k, (len(sizes),), dtype=kind)
                for i, part in enumerate(np.split(np.asarray(flat, np.int32), np.cumsum(sizes)[:-1])):
                    d[i] = part
        else:
            raise ValueError(f"version {version!r} is not 1 or 2")


def read_detector_arrays(path) -> dict[str, np.ndarray]:
    with inner_path(path).open_group() as g:
        return {k: np.asarray(g[k]) for k in ("qx", "qy", "qz", "corr", "mask", "detd", "ewald_rad")}


def write_detector_arrays(path, arrays: dict[str, np.ndarray], overwrite: bool = False) -> None:
    at = inner_path(path)
    with library().File(at.file, "a") as f:
        g = f.require_group(at.name)
        for k, x in arrays.items():
            if k in g:
                if not overwrite:
                    raise FileExistsError(str(at))
                del g[k]
            g[k] = x


def read_array(path) -> np.ndarray:
    at: InnerPath = inner_path(path)
    with library().File(at.file, "r") as f:
        return np.asarray(f[at.name])


def write_array(path, array: np.ndarray, overwrite: bool = False, compression: str | None = None, compression_opts=None) -> None:
    at = inner_path(path)
    with library().File(at.file, "a") as f:
        if at.name in f:
            if not overwrite:
                raise FileExistsError(str(at))
            del f[at.name]
        f.create_dataset(at.name, data=array, compression=compression, compression_opts=compression_opts)
