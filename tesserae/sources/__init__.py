"""Sources and sinks: image catalogs and headers, configuration files, checkpoint manifests, stand-in tables."""
