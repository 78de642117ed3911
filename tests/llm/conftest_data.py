FOLDER = "/root/testdata/sf0.001"
