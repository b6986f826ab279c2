"""SHA-256 of each image of the test corpus, of its RGB bytes, its planes, its transform dump, and its levels at quality 75."""

KNOWN = {
    "blockcheck2_16x16_000_000_000_255_255_255": (
        "ed059db29d960573f7892ff63d8fd57c63d96cc9191814b855e7ea73429cdfd2",
        "265b6a04a37a7bf21f293d4ea282ee84d463bbfbbc4b897c5b55aeda873c88a6",
        "40a46b48957783d2d35181f006077faa6d291524a55f140aff0a0b62c29d8990",
        "0c7f6d9dd5f819f63230ca4ea24f579d40cda493f10341490889cdc09cea888c",
    ),
    "blockcheck2_16x16_000_000_255_255_255_000": (
        "14f1bc2cd7ab0da2192150e11449035a205b55127ac2ef8eba1560da4c4a51d1",
        "dc77b8f8350c6a073eb23f2c3b81c57b3838b679132a3146a4f6994054dc6a52",
        "ded2f60daaabc25404daf5736b7097c521bef3e17660870e6c4120a0d7960d80",
        "f1323ce13705702cbc4bfee70360de51223380eead05c3d8d3029be994943022",
    ),
    "blockcheck2_16x16_017_034_051_254_253_252": (
        "6d0b310520d445045d91d93cff8f6ae474f6e0cb1edd544968f44a1188c7e723",
        "f1d3b161790f40dafacc914c86eda5f57f2d67059928acbdeca735c7906ad5eb",
        "f2816977babc2c7d377044fc6b0beaccbe223af506050d4107313b3620714e19",
        "e52220dd5ea56b305716b7e191e8369f3749a8da2097757469cd4a2652bc93b2",
    ),
    "blockcheck2_16x16_255_000_000_000_255_000": (
        "54bd73f2cef8da7af165fb1b6b2dc096b5af08b017a352471453af682c968752",
        "e4fcc310752c5904fc8827c2e51724a8d21ea98bb9b7c323b3729bf7e78c55e1",
        "c7bd74f090c5dc96b9b745a1ac480bf2b588e95ed31ab68d20430789bf23ce59",
        "800d04d2239291ebb0fd7f69fb5afefb2dceeb7d1bb0f826cfe66b6826d58e55",
    ),
    "checker_16x16_000_000_000_255_255_255": (
        "2a75867172d5cbfd8a931f1f4f975144e44f3ab1f4e19240b3027cffff3188fe",
        "c440f9821bf7e550082c5d4d85f5c6ca78dce9a82cfd50a959ee029131ee9999",
        "5b5e4286a69ac95de13462f5a1c536de800028d753cc2711ca479d603b2ee764",
        "3c3844f36351b47bc73b132cd43675fce66c45f08cd08adfc9358d21eeace443",
    ),
    "checker_16x16_000_000_255_255_255_000": (
        "40ce2d84a6323f831964c626b0f9ca639c45d862ae13cf24d3f5d057a9f7bd39",
        "55a919d608da067133d17a9463f0f96ba19fd6bd2f5aa37bb0a0c112e290162d",
        "fd4e202822308eab8c46eb1ff7a511a0ea4f460ea2cd1f084b4a31cfc57d6881",
        "fd3c09e3daa2f5c26d95baffd5257694a197005d7bfa3a4b065770db92a7f502",
    ),
    "checker_16x16_017_034_051_254_253_252": (
        "e51173fa4e0387ccfb04742b4135509caf86157ddfb6ea32456a7f3c86eb0f04",
        "a80d1f4a52fe93ada943573fe4a9c2134ecb50de726ad93ccaa092d5c79ae06a",
        "358b75f081515781f6a08ad09c2026f0a42047690f530a3bef5e5ea5a30f8fad",
        "3a95fe1d8ef7569dac152ec7f633e82d46fc8beeb53731b0e3dee92ef1f1d64e",
    ),
    "checker_16x16_255_000_000_000_255_000": (
        "ae5b210069ff82eb22711f848bfa4a71b4534713a18195a12440e0f6ebdbc1ac",
        "b9836bcb17c547b086657984741ff5109cd66f809cba7d01cf09ede6324d612c",
        "15b7ff276348ae5f32f2296f9051150a6e2b8e6028e10c97894a16c1acc46c59",
        "c7f6c46d6effaf13c74b41e8f5442b34a79f1d05e3a08075f4f2eeb58b12fce9",
    ),
    "dsplit_16x16_000_000_000_255_255_255": (
        "354065aa634719113eef926907df706a0fb299518c941e3153b4f2aeedba0a74",
        "66fd396399b13984fc922cf4c87911e2769ce96039c7902646f5c7514f48a523",
        "1ed4febb5c799a1ee55098f2b573ad56be4847e2ba9f1b680a790b73e8b2d191",
        "7cb9a350f972a24d0616e2999cf0ef866824ad356924e242f857faf1bbb69cdc",
    ),
    "dsplit_16x16_000_000_255_255_255_000": (
        "709a33b240ac8699124a9e8eed593b2dced8359b20ddc3424550b3807d084cc9",
        "10ca933ef7503cc52276f91b5e7b11650603ece8d757b2483900f84c9ce757f0",
        "f11463db5e1907643d209d218d84e37880ad5e71fba70dbd8e807ee12595c792",
        "5fdafef084dabbe6928c16229ba485b58e8062f2954b6331688762d7144a4b47",
    ),
    "dsplit_16x16_017_034_051_254_253_252": (
        "1f45119dfa019fcf1726dd6bc2fc6b613d4978ccf45df1b845c2767a5bcdf1ac",
        "8160abdf3d921d7b3c0e0921bf50313f7271b4c8bcae285fa00527a1aea96b95",
        "6a6b3aa9116cce2b7bc63bc96db0a4f8f1a5c5fcd2acace316ae9da8eb741672",
        "08f4ce020cc052cb916c43a36a9b92c35d9c548af7a1a0d3db410b3ab246d7fe",
    ),
    "dsplit_16x16_255_000_000_000_255_000": (
        "bef75da4359822d9e13b3a9834894fa2d1351935113aeb0dbaeeed0f1b240329",
        "a5d058200d9a5f03029c748a64e4f1884d5d7785b7ebf4891571c252e683c270",
        "1c8612a25530ec52c7cb7e321adb29557f2d132a26e5e20d99a9a074f7894b7a",
        "fb75f55a4eb26713b81455dcb64399c702f3ea90a93726eb3d761deaf1ce7629",
    ),
    "hgrad_16x16_000_000_000_255_255_255": (
        "203bbea42954461dd2f5a6f908b7c75ee55fba3ba3fa712ccf4bf2b292ed3f59",
        "a568982eb5ba9083a7eaf1bb86b857d190f248707d89f5d59289fa7ad5c8cb3f",
        "e669250539a09dabf9c9f142ffeef9d314ceaec52c67671dd3ed2840ab7769f4",
        "f4b0bc7d929b491c8b2eb9cca6cce4b62348f374e54991053a0b8ea3ca8df917",
    ),
    "hgrad_16x16_000_000_255_255_255_000": (
        "2fc9d7221755ee188e6fa69093cfe3e6da7059027abd94177a5ca171d46646d4",
        "dce7cab2ebcced01cc7ee11055877365f4dda6139a1dd33ea1f694a0acf19d52",
        "8d2afa6108de0802556c86d5c16eff90d5e9c0696eff4d8ea45fd871092d1891",
        "0097bd6f2651ee49f9a8bb0f44a0cfc69f81995e9c2fc337541c3c7966649282",
    ),
    "hgrad_16x16_255_000_000_000_255_000": (
        "87a9e87ee8cdb7f38baceda5d2670cbbf6f155cc75da31e3a0f5057182dc84e2",
        "51218d9c00424327d7254525de7ad50a6d5d6162a4f27298d9007384bf36a421",
        "5a2cac2e16467cb20d45d5061509a0633b3bf4e7ebe4221f6d29783c1de38101",
        "46564d35ad0d3fb1825d78e4ee02b1d41d7aa4dcc982e00147a194c51a25805a",
    ),
    "hsplit_16x16_000_000_000_255_255_255": (
        "33ef9f53636220119d9657d506cd3d52bc9153c5876dc4815ce935cea08cf05a",
        "c0af5652a12b2144d60bd3b7bba955bb8d81c7cb2a1409ab106363b3c7498ee9",
        "e5a1b56f18f36e1b86ae73be67eb3cf135d52cb4f048419c9d9d311bb1cb450d",
        "c2cca2ddf19477a78ba6fd6f6d773722aa4e9e8113c842d5488bb87457043b0f",
    ),
    "hsplit_16x16_000_000_255_255_255_000": (
        "b7c71c54a8d9d23f75ead990370bc2486a906fc0e76b21747a72d0b824592777",
        "ca67227b094c4b065530213597515a66d5130ee63103e07800578170db8c1f7b",
        "8cc93020a8326d5f629f5e827f5a3455e694d4cfa7a7f66a0fb7d970c0db624d",
        "9422ec1414c98dfaa95e755183f5efca532ecfba68bcbf99e9f589fd4412195d",
    ),
    "hsplit_16x16_017_034_051_254_253_252": (
        "b2595ee7a761beb43470a50f378264ae52d4aeb3e976c7e8294ef5daad46193e",
        "c655eccdff3c4979c84a0d2191da64a5a840c5d71dbc074291756b7f8523d80a",
        "ab897f4478b9836695ab22f9956192e1adcadef9cf93abd0f48121343d600083",
        "19107fa2f708df4399c5f08bc3251e64db7e8d696ea8b75fa1f787405e00b9d6",
    ),
    "hsplit_16x16_255_000_000_000_255_000": (
        "7c575f3490575a675e4a27f55236df933cd1a30624626ecc66542a9d63b23280",
        "8ebf01c66a69c1bd0ae7b68ac45ea04f3c5f22ee3454efcae38b12e1a9206344",
        "af34164f4687d7d997f8764f0d6971dbc4eb7b6f8ef133cc3ec8fe2e33ba6967",
        "3af41db4e17a5dab08652a5a3bb89c5257b65899fa17169dd8690c6522660fb7",
    ),
    "solid_rgb_16x16_000_000_000": (
        "ef115a0e0c15cdc41958ca46b5b14b456115f4baec5e3ca68599d2a8f435e3b8",
        "88591e7dbae97bbebd937c7884098002bf4a9a63e21a2c43122bb84e029fc302",
        "0329e0aa703203051ded1348c1bc9a9cdb1ae2b3b5989ad8f4a4c6f8579f0589",
        "97823fdd9d4bd1522087fb2d4f77e20237edd68567c20d617ec448cc12227d7d",
    ),
    "solid_rgb_16x16_000_000_255": (
        "acaaacac1ab48cf37dbe7f72c4b329294b983a88011ed505b9fb7e3877701f50",
        "60f1c4d1f9b512182fd3d3309bb6fd4b94ffaf6bcd391d226b44a78fe61acef1",
        "33602557b74c9f371146cc04364c6bfc49db4c5f24716a19231ba3f68a2dd113",
        "36197000b967cc0ef17c3d1fd968dd9920c4fe41788e065d29acdaba7ff109c6",
    ),
    "solid_rgb_16x16_017_034_051": (
        "b26e76af265678ad797661503bfd83fb17397d927c4d056c5c62a20941893dda",
        "ea8ef86fb54731a85ab7fda9ce2f8cd9a3df84dddc92bbdbb58c329b36bb7f61",
        "201d19947a6797baadf571c61b0a59b560a60c6e5c9288d866c1c38d0bc395e9",
        "a8221cc4673ef26096d38a0463d39a78b7757dda988740df5abae7f604e2421c",
    ),
    "solid_rgb_16x16_255_000_000": (
        "fa8dc828bdf11c88a2f25d1ffc454a0dce698bd7ebe1338bd1402966b43b50c1",
        "b7234a5ada78c264dbae374731c1c7d5aa76b94c7b65a17d7d2bb9844a547f47",
        "09614521eef26ddf7e1e830e3da6a2846a2ace30d7d5aeb6a8b633908e70ec0e",
        "27e860a9ebc585e34c9cc927c43d0222d112bd8f76b02d5756ac261e2bdc2cc6",
    ),
    "vgrad_16x16_000_000_000_255_255_255": (
        "fecd346ab157748648d6857d0ae3c78067ad66bd442e5cb46fce4e9e8db8ea2b",
        "d140dccca7fd32053154dcd8ae4fa35b64c021314b693b12b296319e2090b600",
        "04adb811667e5f031c5260c03dfae342f60fb19e1e2bf33ab6b39896cee3dce6",
        "240ef48fe728544f2424308243a72e18808f7e14eff4dd916f291ef271160b04",
    ),
    "vgrad_16x16_000_000_255_255_255_000": (
        "594486ed0b6af7eeb8b5ab67d1eae013240b7e0d1277e8a89f4ffa92854e9748",
        "fe6502357b90947223a2acf8c791a612e98b076b0764e3b2a3ee5b59a1fb390f",
        "4970a6b0e68143ed914e4d16e8a6f5ac2515ba170fed0cead37c599e7d7ed92e",
        "7335bf47a0c2a8a21d57c8375aaa439c079a211f83ddbe0d113e363e8e8fa22b",
    ),
    "vgrad_16x16_255_000_000_000_255_000": (
        "8e2397c87a0f67efaa6dc5da95f1303ea188e60dddca0b7e12804075f1c9bd80",
        "e77b78771787e451ee93e22f096a8cbd94b1081b8d826a9b0010493968c89f0a",
        "3ca8e8e34b166c157bd47ab6a3a51e2a3025d45350d634541cfc75bcd88a398c",
        "2f6fcfc737f4c57d021f17c1e408d66739cf1995f0c944750c3c38056b74538d",
    ),
    "vsplit_16x16_000_000_000_255_255_255": (
        "c1bba4c36f3c0ecd6bfac50b72a7b42591a491cf7387d4bdcb22af551b4c54ad",
        "ee4abb820563a4efce33b529a05ee829b70d00d5446bfbf616808ff237c3cd49",
        "8e17372aee557f1b7ce70a6948a1e6d97ebeb04dc4ba25d022a2869056c96806",
        "983d83d8d2d89f0b691c7e767d474e8fa802490157cad10d5fc3863f6f0d3714",
    ),
    "vsplit_16x16_000_000_255_255_255_000": (
        "d031b16b20f67cfc372c17a048eaa3b894ae92a7a313995e37bf08b0e92cf8be",
        "a1724371717c179ea6fb2337cd1860b1dc67cd121c68aa0658488505ac076ee2",
        "7bce039111630964b25a9d084f7948570e8130ed7872c9107e59b2c6c3e37f8b",
        "b9801244c1e92368c66956e41828da22a16855289543dd5446b701044783f319",
    ),
    "vsplit_16x16_017_034_051_254_253_252": (
        "4a49ea35693b884cba5a41465e4094824c2a6f5bc1cde4be08a3be04289cfced",
        "401406c21a542123dcc7be02033518bc7fc491635e8beb6f33ed64f21331dd3c",
        "09d79eec325c248b2e9237f2e279801039dc2aa7c9ecc72b4db925b6cd3771d3",
        "b716fc6cbc8ce0fde30bde78c41e648da3b773cf70533e564597b21c4c2b4fff",
    ),
    "vsplit_16x16_255_000_000_000_255_000": (
        "5ab771f462c184e1689c87307b50510260657d8fcd32b552b771776d15320b1d",
        "273e81cbabab6ce5b5f2bad8a33b2d557428e2685c66ecf776b76fe22a6536bf",
        "aa45ef61a26655f4f45ecceef1aefa2dafb7490d981370aa313ea9b0c5fdd106",
        "22b9e0ca285b96f72575f863f826670caadddd3ff5a35fa462203c534fc5a919",
    ),
}
