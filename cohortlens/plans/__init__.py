"""End-to-end jobs (``jobs``), the registered query catalog (``catalog``) and
the independent DuckDB SQL oracle (``oracle``)."""
