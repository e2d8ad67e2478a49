"""Sources: lines and tables from text, files, the network, PDF, images and workbooks."""
