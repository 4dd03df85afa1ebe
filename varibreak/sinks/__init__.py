"""Writers and output record builders."""
